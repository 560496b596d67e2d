"""Which files of a tree are read: extensions, folders that are never source, ignore rules, secrets."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

# fixed values: what is read and what is skipped
EXTENSIONS = set(
    """
    .go .js .jsx .mjs .cjs .ts .mts .cts .tsx .tf .tfvars .json .hcl .py .rs .c .h .cpp .cc .cxx .hpp .hh .hxx .java .cs .rb .rake .php .phtml
    .sh .bash .scala .sc .jl .v .sv .svh .vh .kt .kts .lua .zig .md .mdx .markdown .skill .vue .svelte .astro
    """.split()
)
OUTPUT_DIRS = ["sourceweave-out", ".sourceweave"]
SKIP_DIRS = set(
    """
    node_modules .git .hg .svn dist build target out vendor coverage __snapshots__ .next .nuxt .turbo .svelte-kit .cache .idea .vscode .worktrees
    .terraform .nox .tox site-packages lib64 .eggs .pytest_cache .mypy_cache .ruff_cache
    """.split()
) | set(OUTPUT_DIRS)
SKIP_FILES = {"package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "go.work.sum"}
SERVER_FILES = {".mcp.json", "claude_desktop_config.json", "mcp.json", "mcp_servers.json"}
MANIFESTS = {"pyproject.toml", "go.mod", "pom.xml"}
INTERPRETERS = {"python": ".py", "python3": ".py", "python2": ".py", "node": ".js", "nodejs": ".js", "ruby": ".rb", "bash": ".sh", "sh": ".sh", "dash": ".sh", "zsh": ".sh", "ksh": ".sh", "lua": ".lua", "php": ".php", "julia": ".jl"}
SECRET_DIRS = {".ssh", ".gnupg", ".aws", ".gcloud", "secrets", ".secrets", "credentials"}
SECRET_NAMES = [r"(?i)(^|[\\/])\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$", r"(?i)(\.netrc|\.pgpass|\.htpasswd)$"]
SECRET_WORD = r"(?i)(?<![A-Za-z0-9])(?:credential|secret|passwd|password|private_key)s?(?![A-Za-z])"
DATA_EXTENSIONS = set(".json .yaml .yml .toml .ini .cfg .conf .config .xml .properties .env .txt".split())
DOCUMENT_EXTENSIONS = {".md", ".mdx", ".markdown", ".skill"}


def shebang_ext(head: bytes) -> str:
    """The extension that stands for a script's interpreter; empty if there is none that is known."""
    if not head.startswith(b"#!"):
        return ""
    words = head[2:256].split(b"\n")[0].decode("utf-8", "replace").split()
    name = os.path.basename(words[0]) if words else ""
    if name == "env":
        name = next((os.path.basename(w) for w in words[1:] if not w.startswith("-") and "=" not in w), "")
    return INTERPRETERS.get(name, "")


def is_sensitive(path: str) -> bool:
    """Under a folder of secrets, named like a key store, or named with a secret's word; programs are exempt from the last."""
    parts, name = path.split("/"), os.path.basename(path)
    if any(p in SECRET_DIRS for p in parts[:-1]) or any(re.search(p, name) for p in SECRET_NAMES):
        return True
    ext = os.path.splitext(name)[1].lower()
    if ext in EXTENSIONS and ext not in DOCUMENT_EXTENSIONS and ext not in DATA_EXTENSIONS:
        return False
    bare = name.lstrip(".").split(".")[0]
    few = len([w for w in re.split(r"[-_\s]+", bare) if w]) <= 2
    return any(m.end() == len(bare) or few for m in re.finditer(SECRET_WORD, bare))


def _translate(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return out


@dataclass
class Rule:
    pattern: re.Pattern
    keep: bool
    folders_only: bool


@dataclass
class Ignore:
    """Ignore files from the root down; of the rules that match a path the last one decides."""

    root: str
    rules: dict[str, list[Rule]] = field(default_factory=dict)

    def load(self, folder: str) -> list[Rule]:
        if folder not in self.rules:
            names = [self._exclude()] if not folder else []
            names += [os.path.join(self.root, folder, n) for n in (".gitignore", ".sourceweaveignore")]
            self.rules[folder] = [r for n in names if n and os.path.isfile(n) for r in self._read(n)]
        return self.rules[folder]

    def _exclude(self) -> str:
        git = os.path.join(self.root, ".git")
        if os.path.isfile(git):  # a worktree: its own folder names the common one
            with open(git, errors="replace") as f:
                git = os.path.join(self.root, f.read().partition("gitdir:")[2].strip())
            common = os.path.join(git, "commondir")
            if os.path.isfile(common):
                with open(common) as f:
                    git = os.path.join(git, f.read().strip())
        return os.path.join(git, "info", "exclude")

    @staticmethod
    def _read(path: str) -> list[Rule]:
        out = []
        with open(path, errors="replace") as f:
            for line in f:
                line = line.rstrip("\n\r").rstrip(" ")
                if not line or line.startswith("#"):
                    continue
                keep = line.startswith("!")
                line = line[keep:].removeprefix("\\") if line[keep:].startswith(("\\#", "\\!")) else line[keep:]
                folders, line = line.endswith("/"), line.rstrip("/")
                anchored, line = "/" in line, line.lstrip("/")
                if line:
                    out.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + _translate(line) + r"\Z"), keep, folders))
        return out

    def ignored(self, path: str, folder: bool = False) -> bool:
        """Whether the path, or a folder above it, is ignored."""
        parts = path.split("/")
        for depth in range(1, len(parts) + 1):
            part, is_folder, verdict = "/".join(parts[:depth]), folder or depth < len(parts), False
            for k in range(depth):
                base = "/".join(parts[:k])
                inner = "/".join(parts[k:depth])
                for r in self.load(base):
                    if (is_folder or not r.folders_only) and r.pattern.match(inner):
                        verdict = not r.keep
            if verdict:
                return True
        return False


@dataclass
class Listing:
    files: list[str]
    unsupported: int
    unreadable: list[str]


def walk(root: str, ignore: Ignore):
    """Names below root in order, without folders that are skipped or ignored."""
    failed: list[str] = []
    for folder, dirs, names in os.walk(root, onerror=lambda e: failed.append(e.filename)):
        rel = os.path.relpath(folder, root).replace(os.sep, "/")
        rel = "" if rel == "." else rel + "/"
        dirs[:] = sorted(d for d in dirs if d not in SKIP_DIRS and not d.endswith(".egg-info") and not ignore.ignored(rel + d, True))
        for n in sorted(names):
            yield rel + n
    ignore.failed = [os.path.relpath(f, root) for f in failed]


def collect(root: str) -> Listing:
    """The files that extractors read, sorted; how many others were passed over, and what could not be opened."""
    ignore, files, other = Ignore(root), [], 0
    for rel in walk(root, ignore):
        name = os.path.basename(rel)
        if name in SKIP_FILES:
            continue
        ext = os.path.splitext(name)[1].lower()
        fits = ext in EXTENSIONS or name in SERVER_FILES
        if not fits and not ext:
            try:
                with open(os.path.join(root, rel), "rb") as f:
                    fits = bool(shebang_ext(f.read(256)))
            except OSError:
                pass
        if not fits:
            other += 1
        elif not is_sensitive(rel) and not ignore.ignored(rel):
            files.append(rel)
    return Listing(sorted(files), other, getattr(ignore, "failed", []))


def collect_manifests(root: str) -> list[str]:
    ignore = Ignore(root)
    return sorted(p for p in walk(root, ignore) if os.path.basename(p) in MANIFESTS and not ignore.ignored(p))
