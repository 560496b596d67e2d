"""Linking what single files say: calls to definitions, imports to files, references to documents.

Inputs are tables of fragments: defs (id, name, file, ord), calls (caller_id, callee, file, loc, is_member, ord), imports
(file_id, file, spec, loc, ord), aliases (file, local, imported, module_stem, ord), files (path, idx). ord gives the order
in which fragments were found; where one of several has to win, it decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.families import crosses
from ..functions.ids import clean_join_of, dirname, make_id_of, stem

# fixed values: endings that a relative import may leave out, in the order they are tried
IMPORT_EXTS = [".ts", ".mts", ".cts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".d.ts"]
MARKDOWN_EXTS = [".md", ".mdx", ".markdown"]


def _candidates(rows: DataFrame, base, endings: list[str]) -> DataFrame:
    ends = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(e).alias("end")) for i, e in enumerate(endings)])
    return rows.withColumn("x", F.explode(ends)).withColumn("path", F.concat(base, "x.end"))


def relative_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with target: the file a relative spec means, the first of its possible paths that exists; null if there is none."""
    near = imports.select("file", "spec").where(F.col("spec").rlike("^[./]")).distinct()
    base = near.withColumn("base", clean_join_of(dirname(F.col("file")), F.col("spec")))
    endings = ["", *IMPORT_EXTS, *["/index" + e for e in IMPORT_EXTS]]
    hit = _candidates(base, F.col("base"), endings).join(files.select("path").distinct(), "path").groupBy("file", "spec").agg(F.min_by("path", "x.rank").alias("target"))
    return imports.join(hit, ["file", "spec"], "left")


def definition_files(defs: DataFrame) -> DataFrame:
    return defs.groupBy("id").agg(F.max_by("file", "ord").alias("file"))


def import_guided_calls(calls: DataFrame, defs: DataFrame, aliases: DataFrame) -> DataFrame:
    """Plain calls of a name that the file imports, where the module and the name have one definition."""
    named = aliases.groupBy("file", "local").agg(F.max_by(F.struct("imported", "module_stem"), "ord").alias("a")).select("file", F.col("local").alias("callee"), "a.imported", "a.module_stem")
    one = defs.select(stem(F.col("file")).alias("module_stem"), F.col("name").alias("imported"), "id").groupBy("module_stem", "imported").agg(F.count("*").alias("n"), F.first("id").alias("target")).where("n = 1 AND module_stem <> ''").drop("n")
    hit = calls.where("not is_member").join(named, ["file", "callee"]).join(one, ["module_stem", "imported"]).where("target <> caller_id")
    hit = hit.join(definition_files(defs).toDF("target", "target_file"), "target").where(~crosses(F.col("file"), F.col("target_file")))
    return hit.select(F.col("caller_id").alias("source"), "target", F.lit("calls").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.col("file").alias("source_file"), F.col("loc").alias("source_location"), F.lit(1.0).alias("confidence_score"), "callee", "ord")


def resolve_calls(calls: DataFrame, defs: DataFrame, imported: DataFrame) -> DataFrame:
    """Calls to the definition of that name in the same file; else the only one there is, the only one in an imported file, or the only one in the same folder.

    What decides depends on the name and the caller's file alone, so that is worked out once for each (name, file): counts
    of a name's definitions by file are joined, never calls with definitions.
    """
    where = definition_files(defs).toDF("id", "def_file")
    asked = calls.select("file", F.col("callee").alias("name")).distinct()
    local = defs.groupBy("file", "name").agg(F.max_by("id", "ord").alias("local"))
    by_file = defs.select("id", "name").join(where, "id").groupBy("name", "def_file").agg(F.count("*").alias("n"), F.first("id").alias("id"))
    one = by_file.groupBy("name").agg(F.sum("n").alias("n"), F.first("id").alias("id")).where("n = 1").select("name", F.col("id").alias("only"))
    by_dir = by_file.groupBy("name", dirname(F.col("def_file")).alias("dir")).agg(F.sum("n").alias("n"), F.first("id").alias("id")).where("n = 1").select("name", "dir", F.col("id").alias("beside"))
    seen = asked.join(imported.toDF("file", "def_file"), "file").join(by_file, ["name", "def_file"]).groupBy("file", "name").agg(F.sum("n").alias("n"), F.first("id").alias("id")).where("n = 1").select("file", "name", F.col("id").alias("via"))
    chosen = asked.join(local, ["file", "name"], "left").join(one, "name", "left").join(seen, ["file", "name"], "left").withColumn("dir", dirname(F.col("file"))).join(by_dir, ["name", "dir"], "left")
    chosen = chosen.select("file", F.col("name").alias("callee"), F.coalesce("local", "only", "via", "beside").alias("target")).where("target IS NOT NULL").join(where.toDF("target", "target_file"), "target")
    hit = calls.join(chosen.where(~crosses(F.col("file"), F.col("target_file"))), ["file", "callee"]).where("target <> caller_id")
    return hit.select(F.col("caller_id").alias("source"), "target", F.lit("calls").alias("relation"), F.lit("INFERRED").alias("confidence"), F.col("file").alias("source_file"), F.col("loc").alias("source_location"), "ord")


def suppress(calls: DataFrame, guided: DataFrame) -> DataFrame:
    """Calls but for those at the site (caller, name, line) of a resolved one."""
    done = guided.select(F.col("source").alias("caller_id"), "callee", F.col("source_location").alias("loc")).distinct()
    return calls.join(done, ["caller_id", "callee", "loc"], "left_anti")


def import_links(imports: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of imports, to files or else to a concept node for each other spec; and those nodes."""
    found = relative_imports(imports, files).withColumn("dest", F.coalesce("target", "spec"))
    names = found.select("dest").distinct().withColumn("dest_id", make_id_of(F.array("dest")))
    found = found.join(names, "dest")
    inside = F.col("target").isNotNull()
    links = found.select(F.col("file_id").alias("source"), F.col("dest_id").alias("target"), F.when(inside, "imports_from").otherwise("imports").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.col("file").alias("source_file"), F.col("loc").alias("source_location"), "ord")
    outside = found.where(~inside).groupBy(F.col("dest_id").alias("id")).agg(F.min_by("spec", "ord").alias("label"), F.min("ord").alias("ord"))
    return links, outside.select("id", "label", F.lit("concept").alias("file_type"), F.lit("").alias("source_file"), "ord")


def module_links(refs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and nodes of module sources (refs: from_id, source, file, loc, ord): a folder of the corpus, with the files that it contains, or a concept."""
    local = F.col("source").rlike(r"^(\.\.?$|\.\.?/|/)")
    named = refs.withColumn("local", local).withColumn("path", F.when(local, clean_join_of(dirname(F.col("file")), F.col("source"))).otherwise(F.col("source"))).withColumn("id", make_id_of(F.array(F.lit("tfmodule"), "path")))
    in_dir = files.select(dirname(F.col("path")).alias("dir"), F.col("path").alias("inner"))
    dirs = in_dir.select("dir").distinct().withColumn("is_dir", F.lit(True))
    named = named.join(dirs, (F.col("path") == F.col("dir")) & F.col("local"), "left").withColumn("is_dir", F.coalesce("is_dir", F.lit(False)))
    refer = named.select(F.col("from_id").alias("source"), F.col("id").alias("target"), F.lit("references").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.col("file").alias("source_file"), F.col("loc").alias("source_location"), "ord")
    first = named.groupBy("id").agg(F.min_by(F.struct("path", "is_dir"), "ord").alias("x"), F.min("ord").alias("ord")).select("id", "x.path", "x.is_dir", "ord")
    nodes = first.select("id", F.col("path").alias("label"), F.when(F.col("is_dir"), "code").otherwise("concept").alias("file_type"), F.when(F.col("is_dir"), F.col("path")).otherwise("").alias("source_file"), F.when(F.col("is_dir"), "L1").alias("source_location"), "ord")
    inner = first.where("is_dir").join(in_dir, F.col("path") == F.col("dir")).withColumn("target", make_id_of(F.array("inner")))
    inside = inner.select(F.col("id").alias("source"), "target", F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.col("path").alias("source_file"), F.lit(None).cast("string").alias("source_location"), "ord")
    return refer.unionByName(inside), nodes


def markdown_links(refs: DataFrame, files: DataFrame, defs: DataFrame) -> DataFrame:
    """Links of document references (from_id, target, file, loc, ord): to a Markdown file, or else to the only definition of that name, once from each document."""
    path = F.regexp_replace("target", "#.*$", "")
    inner = (path != "") & ~F.lower(path).rlike("^(https?://|mailto:)")
    asked = refs.select("file", "target").distinct().withColumn("p", path).where(inner).withColumn("folder", F.when(F.col("p").startswith("/"), "").otherwise(dirname(F.col("file"))))
    base = asked.withColumn("base", clean_join_of(F.col("folder"), F.col("p")))
    hit = _candidates(base, F.col("base"), ["", *MARKDOWN_EXTS]).join(files.select("path").distinct(), "path").groupBy("file", "target").agg(F.min_by("path", "x.rank").alias("doc"))
    known = refs.join(hit, ["file", "target"], "left")
    to_doc = known.where("doc IS NOT NULL").withColumn("to", make_id_of(F.array(F.regexp_replace("doc", r"\.[^./]*$", ""))))
    unique = defs.groupBy(F.col("name").alias("target")).agg(F.count("*").alias("n"), F.first("id").alias("to")).where("n = 1").drop("n")
    to_def = known.where("doc IS NULL").where(F.col("target").rlike("^[A-Za-z_][A-Za-z0-9_]*$")).join(unique, "target").groupBy("from_id", "to").agg(F.min_by(F.struct("file", "loc", "ord"), "ord").alias("x")).select("from_id", "to", "x.*")
    both = to_doc.select("from_id", "to", "file", "loc", "ord").unionByName(to_def.select("from_id", "to", "file", "loc", "ord"))
    return both.select(F.col("from_id").alias("source"), F.col("to").alias("target"), F.lit("references").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.col("file").alias("source_file"), F.col("loc").alias("source_location"), "ord")


def index_links(files: DataFrame) -> DataFrame:
    """A folder's index document contains the other Markdown documents of the folder. files: path, idx."""
    docs = files.where(F.lower("path").rlike(r"\.(md|mdx|markdown)$")).withColumn("dir", dirname(F.col("path"))).withColumn("stem", F.lower(stem(F.col("path"))))
    rank = F.when(F.col("path").rlike(r"(^|/)index\.md$"), 0).when(F.col("path").rlike(r"(^|/)index\.mdx$"), 1).when(F.col("path").rlike(r"(^|/)index\.markdown$"), 2)
    index = docs.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("dir").agg(F.min_by("path", "rank").alias("index"))
    inner = docs.where("stem <> 'index'").join(index, "dir")
    bare = lambda c: make_id_of(F.array(F.regexp_replace(c, r"\.[^./]*$", "")))
    return inner.select(bare(F.col("index")).alias("source"), bare(F.col("path")).alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.col("index").alias("source_file"), F.lit(None).cast("string").alias("source_location"), F.col("idx").cast("long").alias("ord"))
