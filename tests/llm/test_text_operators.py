"""The text operators against plain Python on small tables with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourceweave.llm import chat, decontaminate, fingerprint, language, license, minhash, pieces, repeats, suffix, tokens, urls
from sourceweave.llm.common import components, shared_folder
from sourceweave.llm.queries import tokenizer

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 6))) for _ in range(120)]
prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
PASSAGE = prose(90)
LONG = prose(6000)
TEXTS = [None, "", " \n ", "one", PASSAGE, PASSAGE, "Intro. " + PASSAGE + " end", LONG, LONG.replace(WORDS[3], "x", 3), *[prose(rng.randint(5, 200)) for _ in range(20)], "😀" * 300 + PASSAGE[:390], "a" * 900, "CC BY, General Public License! all rights reserved"]
ROWS = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_index():
    t = np.array([rng.randint(1, 4) for _ in range(400)])
    index = suffix.FMIndex(t)
    for size in (1, 2, 5):
        patterns = np.array([[rng.randint(1, 5) for _ in range(size)] for _ in range(40)])
        lo, hi = index.search(patterns)
        for p, a, b in zip(patterns, lo, hi, strict=True):
            want = [i for i in range(len(t) - size + 1) if (t[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(PASSAGE.split()[10:40])), (2, "one"), (3, None), (4, "absent words here"), (5, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: decontaminate.hash_words((t or "").encode())
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    want = {}
    for i, t, *_ in ROWS:
        w, hit, found = words(t), set(), set()
        for p, own in wins.items():
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k : k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    found |= own
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    got = lambda df: {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}
    assert got(decontaminate.report(decontaminate.contaminated_spans(docs, bench))) == want
    assert got(decontaminate.report(decontaminate.contaminated_spans(docs, bench, block_bytes=60))) == want
    assert decontaminate.contaminated_spans(empty, bench).count() == 0
    assert decontaminate.report(decontaminate.contaminated_spans(docs, bench.limit(0))).where("n_hit > 0").count() == 0
    kept = {r.doc_id: r.text for r in decontaminate.clean(docs, bench).collect()}
    assert not any(v[4] for i, v in want.items() if i in kept) and set(kept) == {i for i, v in want.items() if not v[4]}


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_repeats(docs, empty, group, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", group)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.report(repeats.remove_repeats(docs)).collect()}
    assert got == dict(enumerate(repeats.brute_force(TEXTS)))
    if group == 1:
        assert repeats.remove_repeats(empty).count() == 0


def brute_clean(texts):
    """What stays of each text without the bytes of repeated strings and the words, from first to last, of repeated passages."""
    raw, seen, passages = [(t or "").encode() for t in texts], {}, {}
    words = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", r)] for r in raw]
    for i, r in enumerate(raw):
        for k in range(len(r) - 399):
            seen.setdefault(r[k : k + 400], []).append((i, k, k + 400))
        own = [r[a:b] for a, b in words[i]]
        for k in range(len(own) - 49):
            passages.setdefault(tuple(own[k : k + 50]), []).append((i, words[i][k][0], words[i][k + 49][1]))
    gone = [bytearray(len(r)) for r in raw]
    for places in [*seen.values(), *passages.values()]:
        for i, a, b in places if len(places) > 1 else ():
            gone[i][a:b] = b"\1" * (b - a)
    return [None if t is None else bytes(x for x, g in zip(r, own, strict=True) if not g).decode("utf-8", "ignore") for t, r, own in zip(texts, raw, gone, strict=True)]


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_passages_shorter_than_400_bytes(spark, docs, group, monkeypatch):
    """Passages of over 50 words and under 400 bytes, also in other white space, and those of 49 words, which stay."""
    monkeypatch.setattr(repeats, "GROUP", group)
    own = random.Random(11)
    short = lambda n: [own.choice("ab cd ef gh ij kl mn op qr st uv wx yz oo ee".split()) + str(own.randint(0, 9)) for _ in range(n)]
    one, two, few, twin = short(55), short(51), short(49), short(70)
    near = [*twin[:60], "other", *twin[61:]]
    parts = [one, one, one, two, two, few, few, twin, near, ["x"] * 60, [], short(200) + one, one + one, [*two, "a" * 450], ["b" * 450, *two]]
    texts = [" ".join(short(30)) + " " + " ".join(p) + "\n" + " ".join(short(40)) for p in parts]
    texts[1], texts[4] = texts[1].replace(" ", "\n"), texts[4].replace(" ", " \t")
    texts += [texts[8], " ".join(one), *(" ".join(two) + e for e in ("", "\n", " é")), *TEXTS]
    df = spark.createDataFrame([(None if i == 2 else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, row int")
    df = df.union(df.where("row = 3")).repartition(3)  # one row twice
    want = brute_clean([*texts, texts[3]])
    assert len(" ".join(one).encode()) < 400 and " ".join(one) not in want[0] and " ".join(few) in want[5]
    assert sorted((r.row, r.text) for r in repeats.clean(df).collect() if r.text is not None) == sorted((i, t) for i, t in [*enumerate(want[:-1]), (3, want[-1])] if t is not None)


@pytest.mark.parametrize("group", [repeats.GROUP, 1])
def test_repeated_passages_are_reported(spark, group, monkeypatch):
    """op2's rows tell repeated passages that no 400-byte string covers; its figures of strings do not change by them."""
    monkeypatch.setattr(repeats, "GROUP", group)
    own = random.Random(12)
    words = lambda n: [own.choice("ab cd ef gh é".split()) + str(own.randint(0, 99)) for _ in range(n)]
    one, two, few = words(55), words(50), words(49)
    parts = [one, one, few, few, [*two, *words(9), *one], two, words(60), [*one, *one]]
    texts = [" ".join([*words(30), *p, *words(30)]) for p in parts] + [" \n".join(one), PASSAGE, PASSAGE, "", None, "x " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    raw, seen = [(t or "").encode() for t in texts], {}
    places = [[m.span() for m in re.finditer(rb"[^ \t-\r]+", r)] for r in raw]
    for i, own_places in enumerate(places):
        for k in range(len(own_places) - 49):
            seen.setdefault(tuple(raw[i][a:b] for a, b in own_places[k : k + 50]), []).append((i, own_places[k][0], own_places[k + 49][1]))
    hit = [bytearray(len(r)) for r in raw]
    for found in seen.values():
        for i, a, b in found if len(found) > 1 else ():
            hit[i][a:b] = b"\1" * (b - a)
    want = {i: (*figures, len(re.findall(rb"\x01+", h)), sum(h)) for i, (figures, h) in enumerate(zip(repeats.brute_force(texts), hit, strict=True))}
    assert want[0][1] == 0 and want[0][4:] == (1, len(" ".join(one).encode())) and want[2][4:] == (0, 0) and want[4][4] == 2
    got = repeats.report(repeats.remove_repeats(df))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want


def test_long_texts_and_words_in_parts(monkeypatch):
    """Runs of passages do not depend on how texts are cut into batches and parts."""
    import pyarrow as pa

    own = random.Random(3)
    texts = [" ".join(own.choice(WORDS) for _ in range(n)) for n in (3000, 49, 50, 51, 0, 700)] + ["é" * 5000 + " x" * 80]
    found = []
    for size in (repeats.BATCH, 200):
        monkeypatch.setattr(repeats, "BATCH", size)
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "text"])
        starts = set()
        for b in repeats.find_passages(["k"])(iter([batch])):
            for k, s, more, at, size_ in zip(*(b.column(c).to_pylist() for c in ("k", "s", "more", "at", "size")), strict=True):
                assert texts[k].encode()[at : at + size_].decode().split() == texts[k].split()[s : s + more + 50]
                starts |= {(k, s + x) for x in range(more + 1)}
        found.append(starts)
    assert found[0] == found[1] == {(k, s) for k, t in enumerate(texts) for s in range(len(t.split()) - 49)}


def test_difference_cover():
    assert {(a - b) % repeats.V for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.V))


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(minhash.LOWER_TABLE).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_texts():
    base = prose(300).split()
    out = []
    for _ in range(25):  # near copies around the threshold, of which some link only to some
        w = list(base)
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(len(w))] = rng.choice(WORDS) + "z"
        out.append(" ".join(w))
    return out + TEXTS


@pytest.mark.parametrize("block", [minhash.BLOCK, 4])
def test_near_duplicates(spark, empty, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(texts)
    if block == 4:
        assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_among_hosts(spark):
    """Two edited copies of a passage link although thousands of longer documents, none near, fill their buckets."""
    r = random.Random(11)
    made = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    hosts, edited = [], []
    for _ in range(3):
        passage = made(60)
        hosts += [" ".join(made(35) + passage) for _ in range(4000)]
        edited += [" ".join(["x", *passage[1:]]), " ".join([*passage[:-1], "x"])]
    df = spark.createDataFrame(list(enumerate(hosts + edited)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()}
    assert got == {i: i - (i >= len(hosts) and i % 2) for i in range(len(hosts) + 6)}


@pytest.mark.parametrize("split", [minhash.SPLIT, 4])
def test_bucket_pairs_join_what_is_near(spark, split, monkeypatch):
    monkeypatch.setattr(minhash, "SPLIT", split)
    df = spark.createDataFrame(list(enumerate(near_texts())), "doc_id long, text string").repartition(3)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == brute_components([r.text for r in df.orderBy("doc_id").collect()])


def test_pipeline_links_from_080_on(spark):
    import corpus_pipeline

    words = [f"w{k}" for k in range(104)]
    texts = [" ".join(words), " ".join([*words[:91], *[f"v{k}" for k in range(10)]])]  # 87 of 110 shingles: 0.79
    texts += [" ".join(w.upper() + "q" for w in words), " ".join([*[w + "q" for w in words[:94]], *[f"z{k}" for k in range(10)]])]  # 90 of 110: 0.82
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()} == {0, 1, 2}
    assert minhash.near_duplicates(df).where("kept").count() == 4


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (8, 7), (1, 1), (7, 6)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 6: 6, 7: 6, 8: 6}
    assert components(links.limit(0)).count() == 0


def test_pieces(docs, empty):
    import sentencepiece

    path = tokenizer("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["  a  b ", "\n\nx\n", "日本語 ﬁ😀", "</s> a<s>", "▁a ▁", "1.5,x;y", *["".join(rng.choice("ab é\n\t 'l1.▁😀日") for _ in range(rng.randint(0, 40))) for _ in range(300)]]
    vocabulary = pieces.vocabulary(path)
    ids = [np.frombuffer(x, "<u4").tolist() for x in vocabulary.encode(odd)]
    assert ids == library.encode(odd) and [vocabulary.decode(i) for i in ids] == [library.decode(i) for i in ids]
    got = {r.doc_id: r.ids for r in pieces.encode(docs, path).collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate(TEXTS)}
    assert pieces.report(empty, path).count() == 0


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer("byte_bpe_50k.json")
    library, start, want = Tokenizer.from_file(path), 0, {}
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for rows, expect in ((docs, want), (empty, {})):
        out = shared_folder(spark, "tokens")
        tokens.write_tokens(rows, path, out)
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokens.report(tokens.read_tokens(spark, out)).collect()} == expect
        if expect:
            assert [r.start for r in tokens.read_tokens(spark, out, [7]).collect()] == [want[7][0]]
    odd = ["<|endoftext|> a", "don't  I'll\t\tx  ", " x　y", "½²٣ ǅ", *["".join(rng.choice("ab é\n\t 'ls1.▁😀日²½\x1d\xa0") for _ in range(rng.randint(0, 40))) for _ in range(300)]]
    small = tokens.Encoder(path, 20, 20)
    assert [np.frombuffer(x, "<u4").tolist() for x in small(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_licenses(docs, empty):
    r = next(r for r in license.report(license.scan(docs)).collect() if r.doc_id == len(TEXTS) - 1)
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.score) == (8, 3, 0, 5, "cc-by,gpl,reserved", 1.0)
    assert license.report(license.scan(empty)).count() == 0


def test_license_templates(spark, tmp_path):
    """The scan against its SQL over whole notices, notices with inserted words, scattered words and phrases alone."""
    import duckdb

    from sourceweave.llm.sql import OP5

    r = random.Random(9)
    notices = [t for _, t in license.TEMPLATES.values()]
    shuffled = notices[0].split()
    r.shuffle(shuffled)
    inserted = notices[2].split()
    for k in (10, 30, 40):
        inserted.insert(k, "indeed")
    texts = [*notices, *[t.upper().replace(" ", " \n* ", 5) for t in notices], " ".join(shuffled), " ".join(inserted), "general public license", "no gpl: all rights reserved, CC BY; cc-by", *[prose(50) + " " + notices[k] + " " + prose(30) for k in range(3)], " ".join(notices[1].split()[:9]), *TEXTS, "the " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(duckdb.sql(OP5).fetchall())
    got = sorted(map(tuple, license.report(license.scan(df)).collect()))
    assert got == want
    labels = {x[0]: x[6].split(",") for x in got}
    assert all(label in labels[k] and label in labels[k + 5] for k, label in enumerate(license.TEMPLATES))
    assert "apache-notice" in labels[11] and "mit-notice" not in labels[10] and labels[12] == ["gpl"] and "bsd-notice" not in labels[17]


def test_languages(spark, empty):
    sets = {"xx": "abc", "yy": "def"}
    rows = [(i, "".join(rng.choice(sets[lang] + " ") for _ in range(80)), lang) for i in range(60) for lang in [("xx", "yy")[i % 2]]] + [(60, None, "xx"), (61, "12 34", "yy"), (62, "", None), (63, "abc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(df, language.learn(df)).collect()}
    assert all(got[i][0] == lang for i, _, lang in rows[:60]) and [got[i][0] for i in (60, 61, 62)] == ["und"] * 3
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.predict(df, language.learn(empty)).where("lang_pred <> 'und'").count() == 0


def test_urls(spark):
    cases = {"https://a.Example.org/es/x": ("example.org/es/", "block"), "http://example.org/en/152?q": ("example.org/en/1", "block"), "http://x.org/": ("org/", "allow"), "http://x.org": (None, "allow"), "http://a.com/de/": ("com/de/", "block"), "http://a.com/de": (None, "allow"), "nourl": (None, "allow"), None: (None, "allow"), "http://notexample.org/es/": ("org/", "allow")}
    df = spark.createDataFrame(list(enumerate(cases)), "page_id long, url string")
    want = dict(enumerate(cases.values()))
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(df).collect()} == want
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    assert {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules, trie_rules=1).collect()} == want


def test_chats(spark):
    odd = ["</s>", "[INST]", "[\\INST]", "<\\/s>\\\\", "\\", "", None, "</</s>s>", "[[/INST]/INST]\n"]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(odd)] + [(2, None, None, None), (2, 0, "[/INST]", "x"), (3, 0, "assistant", "plain")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.report(chat.format_chats(chat.with_probe(df))).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == digest("".join(f"{('user', 'assistant')[k % 2]}\n{t or ''}\n" for k, t in enumerate(odd)))
    assert got[1].loss_sha256 == digest("".join(t or "" for t in odd[1::2])) and got[-1].loss_chars == len(chat.PROBE)
    assert got[2].n_turns == 2 and got[3].formatted_chars == len("[INST]assistant[/INST]plain</s>")


def test_fingerprints(spark, docs):
    rows = sorted((i, t or "") for i, t in enumerate(TEXTS))
    got = {r.doc_id: r for r in fingerprint.compare_with_edited(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1
    assert got[4].fingerprint == got[5].fingerprint != got[6].fingerprint and got[4].near_next == 1.0 and got[7].near_edited > 0.6
    lines = spark.createDataFrame([(1, "a b\nc d"), (2, "c d\na b"), (3, "a b")], "id long, text string")
    f = {r.id: (r.n, r.wide, r.sums) for r in fingerprint.fingerprints(lines, ["id"]).collect()}
    assert f[1] == f[2] != f[3]
    parts = fingerprint.fingerprints(spark.createDataFrame([(1, "c d")], "id long, text string"), ["id"])
    less = fingerprint.combine(fingerprint.fingerprints(lines.where("id = 1"), ["id"]), parts, -1).first()
    assert (less.n, less.wide, less.sums) == f[3]
    assert fingerprint.compare_with_edited(docs.limit(0)).count() == 0


def brute_fingerprint(text):
    """The wide lanes, the number of word pairs, and the centred projections, in plain Python."""
    import xxhash

    wide = [0] * fingerprint.WIDE
    for line in text.split("\n"):
        digest = hashlib.sha256(line.encode()).hexdigest().encode()
        for k in range(fingerprint.WIDE):
            h = xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(digest, 42))
            wide[k] = (wide[k] + (h & 0xFFFFFFFF)) & 0xFFFFFFFF
    pairs = []
    for line in text.split("\n"):
        w = line.split(" ")
        for i, x in enumerate(w):
            h = xxhash.xxh64_intdigest(x.encode(), 42)
            pairs.append(xxhash.xxh64_intdigest(w[i + 1].encode(), h) if i + 1 < len(w) else h)
    lanes = np.zeros(fingerprint.LANES)
    for h in pairs:
        at = 0
        for own in (h, xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42)):
            for k in range(fingerprint.SHIFTS):
                for j in range(fingerprint.LANES_PER_SUM):
                    lanes[at] += own >> (k + j * fingerprint.LANE_BITS) & 1
                    at += 1
    return wide, len(pairs), 2 * lanes - len(pairs)


def test_fingerprints_by_brute_force(spark, docs):
    rows = sorted((i, t or "") for i, t in enumerate(TEXTS) if t != LONG)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in fingerprint.compare_with_edited(df).collect()}
    want = [brute_fingerprint(t) for _, t in rows]

    def near(a, b):
        if a[1] == b[1] and (a[2] == b[2]).all():
            return 1.0
        norm = np.sqrt((a[2] ** 2).sum()) * np.sqrt((b[2] ** 2).sum())
        return max(0.0, min(1.0, float(a[2] @ b[2] / norm))) if norm else 0.0

    for k, (i, t) in enumerate(rows):
        after, cut = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = brute_fingerprint(t[: len(t) - cut] + after[:cut])
        assert got[i].fingerprint.split("-")[:2] == ["".join(f"{x:08x}" for x in want[k][0]), f"{want[k][1]:x}"]
        assert got[i].edited_fingerprint.split("-")[:2] == ["".join(f"{x:08x}" for x in edited[0]), f"{edited[1]:x}"]
        assert abs(got[i].near_edited - near(want[k], edited)) < 1e-9 and abs(got[i].near_next - near(want[k], want[(k + 1) % len(rows)])) < 1e-9


def test_languages_by_brute_force():
    """Code lengths against prediction by partial matching with plain dictionaries of contexts."""
    r = random.Random(8)
    samples = {"xx": ["".join(r.choice("abc d") for _ in range(200)).encode() for _ in range(3)], "yy": ["".join(r.choice("abe f") for _ in range(200)).encode() for _ in range(3)]}
    model = language.Model(samples)
    counts = {lang: {} for lang in samples}
    pad = b"\n" * language.ORDER
    for lang, texts in samples.items():
        for t in texts:
            t = pad + t.translate(language.LOWER_TABLE)
            for i in range(language.ORDER, len(t)):
                for n in range(language.ORDER + 1):
                    own = counts[lang].setdefault(t[i - n : i], {})
                    own[t[i]] = own.get(t[i], 0) + 1

    def bits(lang, text):
        text, out = pad + text.translate(language.LOWER_TABLE), 0.0
        for i in range(language.ORDER, len(text)):
            for n in range(language.ORDER, -1, -1):
                own = counts[lang].get(text[i - n : i])
                if own is None:
                    continue
                total, kinds = sum(own.values()), len(own)
                if text[i] in own:
                    out -= np.log2(own[text[i]] / (total + kinds))
                    break
                out -= np.log2(kinds / (total + kinds))
            else:
                out += 8
        return out

    texts = [b"abc", b"AbE f zq", b"", "ß日".encode(), bytes("".join(r.choice("abcdef z") for _ in range(500)), "ascii"), b"ab" * 40]
    got = model.bits(texts)
    for i, t in enumerate(texts):
        assert np.allclose(got[i], [bits(lang, t) for lang in model.langs], rtol=1e-4, atol=1e-3)


def test_language_of_long_documents_only(spark):
    df = spark.createDataFrame([(i, "abc " * 100, "xx") for i in range(6)] + [(10, "zyx " * 1000, "yy"), (11, "zyx " * 1000, "yy"), (12, "zyx " * 1000, "yy"), (20, "zyx zyx", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language.predict(df, language.learn(df, 500)).collect()}[20] == "yy"


def test_equal_code_lengths_go_to_the_first_language(spark):
    df = spark.createDataFrame([(i, "abc abd", lang) for i in range(20) for lang in ("yy", "xx")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.predict(df, language.learn(df)).collect()} == {"xx"}


def test_long_words_that_weak_hashes_confuse(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(0, one), (1, one.translate(str.maketrans("ab", "ba"))), (2, one)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()} == {0: 0, 1: 1, 2: 0}


def test_clashing_names_and_repeated_rows(spark):
    """Columns named like those that operators use inside, null ids, and one row many times."""
    names = "doc_id long, text string, lang string, row_ int, spans string, th_ int, th int, score int, lang_pred string, bits int, a int, h int, row int, hits int, kept int"
    rows = [(None if k == 8 else 7 if k < 5 else k, PASSAGE if k < 6 else f"free of it {k}" if k < 9 else None, "en", *[k] * 1, "s", k, k, k, "x", k, k, k, k, k, k) for k in range(10)]
    df = spark.createDataFrame(rows, names)
    bench = spark.createDataFrame([(1, " ".join(PASSAGE.split()[:20]), 5)], "item_id long, text string, row_ int")
    for out, stay in ((decontaminate.clean(df, bench), range(6, 10)), (repeats.clean(df), range(10))):
        assert out.columns == df.columns
        assert sorted((r.th_, r.th, r.kept) for r in out.collect()) == [(k, k, k) for k in stay]
    assert language.predict(df, language.learn(df)).count() == 10
    got = repeats.report(repeats.remove_repeats(df)).collect()
    want = repeats.brute_force([r[1] for r in rows])
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    near = minhash.near_duplicates(df).collect()
    assert len(near) == 10 and sum(r.component_id == 5 for r in near) == 6 and sum(r.kept for r in near if r.component_id == 5) == 1
    for out in (repeats.clean(df.limit(0)), decontaminate.clean(df.limit(0), bench)):
        assert out.count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.withColumn("extra_th", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, prose(20))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "repeats", "benchmark", "sentencepiece"]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    comps = brute_components([t if t and any(c.isalpha() for c in t) else None for t in TEXTS])
    kept = [i for i, t in enumerate(TEXTS) if t and any(c.isalpha() for c in t) and comps[i][1] == i]
    assert set(got) <= set(kept) and len(got) >= len(kept) - 1
    left = repeats.brute_force([TEXTS[i] for i in kept])
    for i, (_, removed, _, sha) in zip(kept, left, strict=True):
        if i in got and removed == 0 and got[i].same:
            assert got[i].decoded_sha256 == sha
