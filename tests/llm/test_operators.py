import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from barloom.llm import exact_dedup, langid, line_dedup, mixing, packing, pii, quality_rules, queries, simhash, substring_dedup, toxicity
from barloom.llm.common import spread
from barloom.llm.components import components

from . import brute


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# exact dedup


@pytest.mark.parametrize("capacity", [2, 50_000])
def test_exact(spark, capacity):
    df = brute.awkward(spark)
    got = exact_dedup.exact_dedup(df, capacity).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute.exact(pairs(df))
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert set(kept.values()) == {1} and len(kept) == len({r["text_sha256"] for r in got})
    assert exact_dedup.exact_dedup(brute.empty(spark)).count() == 0


def test_exact_by_bytes_alone(spark):
    df = brute.awkward(spark)
    got = exact_dedup._by_bytes(df.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ").alias("norm"))).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute.exact(pairs(df))


def grow(keys, capacity):
    """The directory of 64-bit keys, and how it was asked for."""
    asked = []

    def count(of, depth):
        asked.append(depth)
        local = of[0][1]
        under = [k for k in keys if not local or (k >> (64 - local), local) in of]
        return Counter(k >> (64 - depth) if depth else 0 for k in under)

    return exact_dedup.directory(count, capacity), asked


def test_directory_doubles_until_buckets_fit():
    rng = random.Random(1)
    near = rng.getrandbits(30) << 34
    for keys in ([rng.getrandbits(64) for _ in range(3000)], [near | rng.getrandbits(12) for _ in range(500)] + [rng.getrandbits(64) for _ in range(100)], [7], []):
        buckets, asked = grow(keys, 20)
        at = 0
        for prefix, depth, n in buckets:  # they cover all keys once, in order, and none is overfull
            assert prefix << (64 - depth) == at and n <= 20
            assert n == sum(prefix == k >> (64 - depth) if depth else True for k in keys)
            at += 1 << (64 - depth)
        assert at == 1 << 64 and asked == sorted(asked)
    assert (5, 64, 100) in grow([5] * 100, 20)[0]  # one key cannot be split: no bits are left


def test_owner_compares_bytes_and_chains_collisions():
    """Entries of one key: equal bytes merge, other bytes are another link, a shared digest is reported."""
    row = lambda key, digest, text, rep, n, ties=1: {"bucket": 0, "key": key, "digest": digest, "text": text, "missing": rep is None, "rep": rep, "n": n, "ties": ties}
    rows = [row(1, b"d", b"x", 5, 2), row(1, b"e", b"y", 4, 1), row(1, b"d", b"x", 3, 7), row(1, b"d", b"z", None, 1), row(1, b"d", b"x", None, 1), row(2, b"f", None, 9, 1), row(3, b"g", b"t", 2, 3, 2), row(3, b"g", b"t", 2, 1)]
    batches = [pa.RecordBatch.from_pylist(rows[:3]), pa.RecordBatch.from_pylist(rows[3:])]
    got = [tuple(r.values()) for b in exact_dedup._own(iter(batches)) for r in b.to_pylist()]
    assert got == [(1, b"d", 0, 3, 10, 1, True), (1, b"e", 1, 4, 1, 1, False), (1, b"d", 2, None, 1, 1, True), (2, b"f", 0, 9, 1, 1, False), (3, b"g", 0, 2, 4, 3, False)]


def test_the_index_decides(spark, monkeypatch):
    """Without the owners' comparison copies are told apart no more."""
    df = spark.createDataFrame([(k, "a text" if k % 3 else f"text {k}") for k in range(60)], "doc_id long, text string").repartition(8)
    assert {r["group_size"] for r in exact_dedup.exact_dedup(df).collect()} == {1, 40}
    monkeypatch.setattr(exact_dedup, "_own", exact_dedup_unmerged)
    assert exact_dedup.exact_dedup(df).where("group_size = 40").count() == 0


def exact_dedup_unmerged(batches):
    for b in batches:
        n = b.num_rows
        columns = [b.column("key"), b.column("digest"), pa.array([0] * n, pa.int32()), b.column("rep"), b.column("n"), b.column("ties"), pa.array([False] * n)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "link", "rep", "n", "ties", "clash"])


BIG = (1 << 53) + 1


def test_long_ids_beside_a_null_id_stay(spark):
    """No operator passes ids through floating point."""
    df = spark.createDataFrame([(BIG, "a b c\nmail a@b.cc", "en", "s", 1), (None, "a b c\nmail a@b.cc", "en", "s", 1), (BIG + 2, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    want = {BIG, None, BIG + 2}
    for got in (exact_dedup.exact_dedup(df), substring_dedup.substring_dedup(df), pii.personal_data(df), simhash.simhash_groups(df), quality_rules.quality_report(df), toxicity.toxicity(df, labels), mixing.Mix(df).taken(), langid.language(df), packing.pack(df), line_dedup.line_dedup(df)):
        assert {r["doc_id"] for r in got.collect()} == want
    assert {r["keep_id"] for r in exact_dedup.exact_dedup(df).collect()} == {BIG, BIG + 2}


# simhash


def test_fingerprints(texts):
    for t in [None, "", "One", "two Words", "ÀB c D e", *list(texts.values())[:30]]:
        assert simhash.fingerprint(t) == brute.fingerprint(t)


def test_simhash_groups(spark, docs, texts):
    for df in (docs, brute.awkward(spark)):
        rows = pairs(df)
        got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect()), key=str)
        fps = [brute.fingerprint(t) for _, t in rows]
        assert got == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, brute.components([i for i, _ in rows], fps), strict=True)), key=str)
    assert simhash.simhash_groups(brute.empty(spark)).count() == 0


@pytest.mark.parametrize("block", [3, 4096])
def test_links_lose_nothing(spark, block):
    """Dense clusters and random fingerprints; small blocks deal crowded anchors into pairs of blocks."""
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(40):
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            x = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    rows = [(x - (1 << 64) if x >> 63 else x, k) for k, x in enumerate(fps)]
    found = components(simhash.links(spark.createDataFrame(rows, "fp long, rep long"), 3, block))
    of = {r["node"]: r["component"] for r in found.collect()}
    least: dict[int, int] = {}
    for x, k in rows:
        least[of.get(x, x)] = min(k, least.get(of.get(x, x), k))
    assert [least[of.get(x, x)] for x, _ in rows] == brute.components(list(range(len(fps))), fps)


def test_hot_keys_are_joined_where_they_lie(spark):
    rows = spark.createDataFrame([(k, 7 if k < 500 else k, "r") for k in range(800)], "id long, key long, more string")
    table = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    got = spread(rows, table, ["key"], "n", 800)
    assert got.columns == ["id", "key", "more", "n", "least"]
    assert sorted(map(tuple, got.collect())) == [(k, 7, "r", 500, 0) if k < 500 else (k, k, "r", 1, k) for k in range(800)]


def test_a_row_without_an_id_links(spark, monkeypatch):
    """It joins what it links: the groups on both of its sides are one, and it has their smallest id."""
    words = [f"w{k}" for k in range(400)]
    base = " ".join(words)
    fps = {t: brute.fingerprint(t) for t in (" ".join([*words[:k], "x", *words[k + 1 :]]) for k in range(400))}
    near = [t for t, f in fps.items() if 0 < (f ^ brute.fingerprint(base)).bit_count() <= 3][:3]
    rows = [(7, near[0]), (None, base), (3, near[1]), (None, "all alone here"), (None, "all  alone here"), (9, base), (9, "another text of id nine")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_groups(df).collect())
    prints = [brute.fingerprint(t) for _, t in rows]
    assert got == Counter((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, prints, brute.components([i for i, _ in rows], prints), strict=True))
    assert sorted((r["doc_id"] or 0) for r in simhash.keep_one(df).collect()) == [0, 3, 9]


@pytest.mark.parametrize("hub", [2, 64])
def test_components_of_hubs(spark, monkeypatch, hub):
    import barloom.llm.components as module

    monkeypatch.setattr(module, "HUB", hub)
    rng = random.Random(3)
    edges = [(0, k) for k in range(1, 200)] + [(500 + k, 501 + k) for k in range(40)] + [(1000, k) for k in range(1001, 1050)] + [(1049, 199)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(90)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}
    root = lambda x: x if up.get(x, x) == x else root(up[x])
    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_anchors_cover():
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    rows, keys, homes = simhash.anchors(fps)
    at = defaultdict(set)
    for r, k in zip(rows.tolist(), keys.tolist(), strict=True):
        at[r].add(k)
    assert all(len(v) in (2, 17, 32) for v in at.values())
    for k, x in enumerate(fps.tolist()):
        y = x ^ (1 << int(rng.integers(0, 31))) ^ (1 << 40) ^ (1 << 50)
        r2, k2, h2 = simhash.anchors(np.array([y], np.uint64))
        assert at[k] & set(k2[h2].tolist())


def test_keep_one(spark):
    df = brute.awkward(spark)
    got = simhash.keep_one(df)
    assert got.columns == df.columns
    rows = pairs(df)
    assert got.count() == len(set(brute.components(list(range(len(rows))), [brute.fingerprint(t) for _, t in rows])))


# lines


def lines_by_hand(rows, max_ratio, min_pages, copies_once=False):
    """rows: (host, text) -> texts without the lines above the ratio."""
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    lines = lambda t: {strip(x) for x in t.split("\n")} - {""}

    def over(pages):
        """pages: (host, class, lines); those of one class are one page."""
        total, held = defaultdict(set), defaultdict(set)
        for h, c, ls in pages:
            total[h].add(c)
            for x in ls:
                held[h, x].add(c)
        return {k for k, v in held.items() if len(v) >= min_pages and len(v) > max_ratio * len(total[k[0]])}

    pages = [(h or "", t or "") for h, t in rows]
    if not copies_once:
        bad = over([(h, k, lines(t)) for k, (h, t) in enumerate(pages)])
    else:
        first, again = over([(h, t, lines(t)) for h, t in pages]), []
        for h, t in pages:
            found = {x for x in lines(t) if (h, x) in first}
            copied = found and sum(map(len, found)) >= line_dedup.COPIED * sum(map(len, lines(t)))
            signed = lambda x: xxhash.xxh64_intdigest(x.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(x.encode(), 42) >> 63)
            again.append((h, ("signature", min(map(signed, found))) if copied else t, found))
        bad = over(again)
    return ["\n".join(x for x in t.split("\n") if (h or "", strip(x)) not in bad) if t else t for h, t in rows]


def test_lines(spark, docs):
    for df, ratio, least in ((docs, 0.1, 3), (brute.awkward(spark), 0.3, 2)):
        done = line_dedup.line_dedup(df, "text", "source", max_ratio=ratio, min_pages=least)
        assert done.columns == [*df.columns, "__lines", "__dropped"]
        rows = [(r["source"], r["text"]) for r in df.collect()]
        assert sorted(((r["source"], r["text"]) for r in done.collect()), key=str) == sorted(zip([h for h, _ in rows], lines_by_hand(rows, ratio, least), strict=True), key=str)
        once = line_dedup.line_dedup(df, "text", "source", max_ratio=ratio, min_pages=least, copies_once=True)
        assert sorted(((r["source"], r["text"]) for r in once.collect()), key=str) == sorted(zip([h for h, _ in rows], lines_by_hand(rows, ratio, least, True), strict=True), key=str)
    assert line_dedup.line_dedup(brute.empty(spark)).count() == 0
    assert line_dedup.line_dedup(brute.empty(spark), copies_once=True).count() == 0


def test_a_text_with_many_copies_keeps_its_lines(spark):
    rows = [(k, "one line\nmenu\nanother line", "s") for k in range(40)] + [(100 + k, f"text {k}\nmenu\nmore {k}", "s") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, copies_once=True).collect()}
    assert all(got[k] == "one line\nanother line" for k in range(40)) and got[103] == "text 3\nmore 3"


def test_near_copies_count_once(spark):
    """Forty near copies of one text, each with another line changed, in a source of a hundred pages, and three in one of
    twenty: they keep their lines; the menu of all other pages goes, from them too."""
    text = [f"line {k} of the text that is copied" for k in range(9)]
    near = lambda k: "\n".join([*text[: k % 9], f"changed {k}", *text[k % 9 + 1 :], "menu"])
    other = lambda k: f"a text of its own, number {k}\nmenu\nand its other lines {k}"
    rows = [(k, near(k), "s") for k in range(40)] + [(100 + k, other(k), "s") for k in range(60)] + [(200 + k, near(k), "t") for k in range(3)] + [(300 + k, other(k), "t") for k in range(17)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, df, "").collect()}
    assert got == {i: t.replace("\nmenu", "") for i, t, _ in rows}


def test_page_lines(spark):
    html = "<html><script>var a='<p>';</script><nav>menu</nav><p>text {}</p><!-- no --></html>"
    df = spark.createDataFrame([(k, f"https://u@Host.example:80/{k}?q", html.format(k), "x") for k in range(5)] + [(9, None, None, "x"), (10, "nonsense", "<p>", "x")], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.page_line_dedup(df).collect()}
    assert got[3] == ("host.example", 2, 1, "text 3") and got[9] == ("", 0, 0, "") and got[10] == ("", 0, 0, "")


# passages


def test_chunks_join_to_the_text(texts):
    for t in [*list(texts.values())[:20], "", "é" * 1000, "a" * 5000]:
        raw = t.encode()
        ends = substring_dedup.cuts(raw)
        assert b"".join(raw[a:b] for a, b in zip([0, *ends], ends, strict=False)) == raw
        for a, b in zip([0, *ends], ends, strict=False):
            raw[a:b].decode()
            assert b - a <= substring_dedup.LARGEST


def test_gear_in_slabs(monkeypatch):
    raw = np.random.default_rng(1).integers(32, 127, 10_000, dtype=np.uint8).tobytes()
    whole = substring_dedup.cuts(raw)
    monkeypatch.setattr(substring_dedup, "_SLAB", 777)
    assert substring_dedup.cuts(raw) == whole


def test_insertions_move_few_chunks():
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(2000))
    a, b = (set(substring_dedup.chunks(t)[0].tolist()) for t in (text, "inserted " + text[:3000] + "!" + text[3000:]))
    assert len(a - b) <= 0.03 * len(a)


def test_passages_go_and_clean_text_stays(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(k, f"{text(80)} {passage} {text(40)}" if k % 3 == 0 else text(150)) for k in range(60)] + [(100, None), (None, passage)]
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    before = dict(rows)
    words = passage.split()
    for k in range(60):
        if k == 0 or k % 3:
            assert got[k]["text"] == before[k] and got[k]["n_removed"] == 0
        else:
            assert sum(w in got[k]["text"].split() for w in words) < 25
            for a, b in got[k]["removed"]:
                assert before[k][a:b] in f" {before[0]} "
            kept, at = [], 0
            for a, b in got[k]["removed"]:
                kept.append(before[k][at:a])
                at = b
            assert "".join(kept) + before[k][at:] == got[k]["text"]
    assert got[None]["text"] == passage and got[100]["text"] is None


def test_passages_against_brute_force(spark, docs, texts):
    for df, rows in ((docs, list(texts.items())), (brute.awkward(spark), pairs(brute.awkward(spark)))):
        got = Counter((r["doc_id"], r["text"], r["n_chunks"], r["n_removed"], str([list(x) for x in r["removed"]])) for r in substring_dedup.substring_dedup(df).collect())
        assert got == Counter(brute.without_passages(rows, substring_dedup._GEAR.tolist(), 16, 128, 4, 150))
    assert any(r["n_removed"] for r in substring_dedup.substring_dedup(docs).collect())


def test_passages_of_empty_tables(spark):
    assert substring_dedup.substring_dedup(brute.awkward(spark)).count() == 14
    assert substring_dedup.substring_dedup(brute.empty(spark)).count() == 0


# quality


def test_base_stats(spark, docs):
    for df in (docs, brute.awkward(spark)):
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.base_stats(df).collect())
        assert got == Counter((i, *brute.base_stats(t)) for i, t in pairs(df))


def test_mcd_rejects_planted_outliers(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows = [(k, " ".join(word() + ("%%$" if k % 20 == 0 else "") for _ in range(100)), "en", "s") for k in range(400)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(v == (k % 20 != 0) for k, v in got.items())
    assert quality_rules.quality_report(brute.awkward(spark)).count() == 14
    assert quality_rules.quality_report(brute.empty(spark)).count() == 0


def test_each_statistic_can_reject_alone(spark):
    """One group of plain texts with one odd text for each statistic; a header repeated once, and small groups, are judged by the language."""
    rng = random.Random(16)
    word = lambda n=8: "".join(rng.choices("abcdefghij", k=rng.randint(2, n)))
    plain = lambda: [" ".join(word() for _ in range(12)) for _ in range(10)]
    texts = ["\n".join(plain()) for _ in range(300)]
    odd = {
        "long words": " ".join("".join(rng.choices("abcdefghij", k=20)) for _ in range(100)),
        "symbols": " ".join(w + "%" * (k % 3 == 0) for k, w in enumerate(" ".join(plain()).split())),
        "lines": "\n".join([*plain(), *["menu"] * 4]),
        "repeated words": "\n".join([*plain(), (x := " ".join(word() for _ in range(11))), word(), x]),
        "capitals": " ".join(w.upper() if k % 3 == 0 else w for k, w in enumerate(" ".join(plain()).split())),
    }
    fine = {"header": "\n".join(["A header", *plain(), "A header"]), "empty group": "\n".join(plain())}
    rows = [(k, t, "en", "s") for k, t in enumerate([*texts, *odd.values()])] + [(1000 + k, t, "en", f"few{k}") for k, t in enumerate([*odd.values(), *fine.values()])]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [k for k in range(300) if not got[k]] == []
    assert [n for k, n in enumerate(odd) if got[300 + k] or got[1000 + k]] == []
    assert all(got[1000 + len(odd) + k] for k in range(len(fine)))


# toxicity and language


def labelled(spark, n=400):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    docs, labels = [], []
    for k in range(n):
        w = [word() for _ in range(rng.randint(20, 200))]
        if k % 7 == 0:
            for x in rng.sample(["zounds", "xylith", "quorvex", "vrimble"], 3):
                w.insert(rng.randrange(len(w)), x)
        docs.append((k, " ".join(w), "en", "s"))
        labels.append((k, int(k % 7 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in got)


def test_toxicity_edges(spark):
    docs, labels = labelled(spark, 80)
    assert toxicity.toxicity(brute.awkward(spark), labels).count() == 14
    assert toxicity.toxicity(brute.empty(spark), labels).count() == 0
    none = labels.where("toxic > 5")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} <= {toxicity.fit([]).score("")}


def test_machine_learns_a_pair():
    """Neither word marks the label, both together do: what additive weights miss."""
    rng = random.Random(9)
    rows = []
    for _ in range(1500):
        a, b = rng.random() < 0.5, rng.random() < 0.3
        rows.append((int(a and b), toxicity.terms(f"{'left' if a else 'none'} {'right' if b else 'else'} " + " ".join(rng.choices("pqrstuv", k=3)))))
    m = toxicity.fit(rows)
    assert m.score("left right") > 0.5 > max(m.score("left else"), m.score("none right"))


def test_machine_keeps_terms_without_a_lift_of_their_own():
    """A group word that is common in clean text, an insult that is clean alone, and a word that speaks for clean text."""
    rng = random.Random(4)
    rows = []
    for _ in range(2000):
        insult, group = rng.random() < 0.6, rng.random() < 0.6
        clean = not (insult and group) and rng.random() < 0.5
        rows.append((int(insult and group), toxicity.terms(f"{'oaf' * insult} {'folk' * group} {'calm' * clean} " + " ".join(rng.choices("pqrstuv", k=3)))))
    m = toxicity.fit(rows)
    assert all(int(toxicity.terms(w)[0]) in m.at for w in ("oaf", "folk", "calm"))
    assert m.score("oaf folk p q") > 0.5 > max(m.score("oaf p q"), m.score("folk p q"), m.score("oaf folk calm p q"))


def test_language(spark, data, docs):
    got = langid.language(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.language(brute.awkward(spark)).collect()}
    assert odd[3] == odd[4] == odd[5] == "und" and odd[6] == "en"
    assert langid.language(brute.empty(spark)).count() == 0
    digits = docs.limit(3).withColumn("text", F.lit("123 ² --"))
    assert {r["lang_pred"] for r in langid.language(digits).collect()} <= {"und"}


def test_language_against_brute_force(spark, docs):
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language(docs).collect()}
    want = brute.languages(rows, langid.LETTERS_RE)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-3 for k in want)


def test_words_keep_their_marks(spark):
    hindi, thai = "नमस्ते दुनिया यह हिन्दी है", "สวัสดี ชาวโลก นี่ คือ ภาษาไทย"
    assert langid.LETTERS_RE.findall(hindi) == hindi.split() and langid.LETTERS_RE.findall(thai) == thai.split()
    rows = [(k, (hindi if k % 2 else thai), "hi" if k % 2 else "th") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r["lang_pred"] == ("hi" if r["doc_id"] % 2 else "th") for r in langid.language(df).collect())


def test_backoff_falls_to_shorter_grams():
    m = langid.Backoff(["a", "b"], [{"katten": 5, "hund": 5}, {"zebra": 5, "quokka": 5}])
    assert m.predict("katten")[0] == "a" and m.predict("kattenz")[0] == "a" and m.predict("zebr")[0] == "b" and m.predict("q")[0] == "b"


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(texts):
    rng = random.Random(10)
    odd = ["a@b", "x@y@z.com a@b.c@d.e", "1.2.3.4.5.6.7.8 999.1.1.1", "00001.2.3.4", "4111 1111-1111 1111", "+1 (988) 555-2485", "+12", "@.com a..b@c.d.", "ü@b.de", "4" * 40]
    noise = ["".join(rng.choices("ab1.@+- (4)\n", k=200)) for _ in range(300)]
    for t in [*odd, *noise, *texts.values()]:
        assert pii.base_spans(t) == plain_spans(t), t


def test_personal_data(spark, docs, texts):
    for df in (docs, brute.awkward(spark)):
        by = defaultdict(list)
        for i, t in pairs(df):
            by[i].append(plain_spans(t))
        for r in pii.personal_data(df).collect():
            listed = [",".join(f"{k}:{a}:{b}" for k, a, b in spans) for spans in by[r["doc_id"]]]
            assert r["base_sha256"] in {hashlib.sha256(x.encode()).hexdigest() for x in listed}
            assert any(set(x.split(",")) <= set(r["spans"].split(",")) or not x for x in listed)
            assert any(tuple(sum(s[0] == k for s in spans) for k in PATTERNS) == (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for spans in by[r["doc_id"]])
    assert pii.personal_data(brute.empty(spark)).count() == 0


def mentions(seed, n):
    """Filler texts, each with a clear mention."""
    rng = random.Random(seed)
    filler = lambda: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randint(2, 8))) for _ in range(rng.randint(10, 80)))
    return [f"{filler()} {pii.fresh_span(rng, rng.choice(pii.KINDS))} {filler()} in 1998 and 20 more" for _ in range(n)]


def measured(field, texts, seed):
    """(precision, recall) of the spans that the field adds to texts with planted mentions."""
    rng, right, more, missed = random.Random(seed), 0, 0, 0
    for t in texts:
        planted, labels = pii.plant(t, rng)
        base, every = pii.find(planted, field)
        assert set(base) <= set(every) and base == plain_spans(planted)
        gold, got = {x for x in labels if x[0]} - set(base), set(every) - set(base)
        right, more, missed = right + len(gold & got), more + len(got - gold), missed + len(gold - got)
    return right / (right + more), right / (right + missed)


def test_the_field_adds_whole_spans():
    """Planted mentions beyond the patterns on texts that the fit has not seen; without skip edges repeats are lost."""
    examples = [e for k, t in enumerate(mentions(1, 400)) if (e := pii.example(t, random.Random(k)))]
    field = pii.fit(examples)
    precision, recall = measured(field, mentions(2, 300), 3)
    assert precision >= 0.9 and recall >= 0.9
    alone = pii.Field(field.names, field.unary, field.chain, field.skip * 0)
    assert measured(alone, mentions(2, 300), 3)[1] < recall - 0.1
    text = "ring +1 (988) 555-2485 or later 9885552485 but order 4135550199, write to jo.doe [at] host [dot] com"
    kinds = {text[a:b]: k for k, a, b in pii.find(text, field)[1]}
    assert kinds == {"+1 (988) 555-2485": "phone", "9885552485": "phone", "jo.doe [at] host [dot] com": "email"}
    back = "order 9885552485 came, ring +1 (988) 555-2485"  # the label goes to a mention before the clear one as well
    assert {back[a:b] for _, a, b in pii.find(back, field)[1]} == {"9885552485", "+1 (988) 555-2485"}


def test_the_fit_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.createDataFrame(list(enumerate(mentions(5, 120))), "doc_id long, text string")
    a, b = pii.train(docs.repartition(5)), pii.train(docs.orderBy(F.desc("doc_id")).coalesce(1))
    assert a.names == b.names and (a.unary == b.unary).all() and (a.skip == b.skip).all()


def test_mentions_in_long_texts_take_linear_time():
    field = pii.fit([e for k, t in enumerate(mentions(6, 60)) if (e := pii.example(t, random.Random(k)))])
    for text in ("1234567," * 20_000, "a@" * 100_000, " at x dot y" * 20_000, "9" * 300_000, "a[at]" * 50_000):
        base, every = pii.find(text, field)
        assert set(base) <= set(every)


# mixing


def test_mix(spark, docs):
    for df in (docs, brute.awkward(spark)):
        rows = mixing.Mix(df).taken().collect()
        assert len(rows) == df.count()
        source = {r["doc_id"]: r["source"] for r in df.collect()}
        total, taken, target, size = sum(r["size"] for r in rows), Counter(), {}, Counter()
        for r in rows:
            assert r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] + 1e-9
            taken[source[r["doc_id"]]] += r["taken"]
            size[source[r["doc_id"]]] += r["size"]
            target[source[r["doc_id"]]] = r["target"]
            assert (r["first_slot"] == -1) == (r["n_slots"] == 0) == (r["taken"] == 0)
        if len(source) == len(rows):
            assert all(abs(taken[k] - target[k]) < 1 for k in target)
            assert sum(target.values()) == pytest.approx(min(1.5 * total, 2 * sum(size.values())))
        assert 1.5 * total - len(target) <= sum(r["taken"] for r in rows) <= 1.5 * total + 1
    assert mixing.Mix(brute.empty(spark)).taken().count() == 0


def test_schedule_is_low_discrepancy_and_whole(spark, docs):
    mix = mixing.Mix(docs)
    quota = {r["no"]: r["quota"] for r in mix.sources.collect()}
    target = {r["no"]: r["target"] for r in mix.sources.collect()}
    slots = sorted((r["slot"], r["no"], r["block"]) for r in mix.schedule().collect())
    blocks = {no: -(-q // mix.block) for no, q in quota.items()}
    assert Counter(no for _, no, _ in slots) == Counter({k: v for k, v in blocks.items() if v})
    for no in blocks:
        assert [b for _, n, b in slots if n == no] == list(range(1, blocks[no] + 1))
    whole, seen = sum(target.values()), Counter()
    for k, (_, no, _) in enumerate(slots, 1):
        seen[no] += 1
        if k <= 0.9 * len(slots):
            assert all(abs(seen[n] - k * target[n] / whole) < 6 for n in target)
    words = Counter()
    for r in mix.pieces().collect():
        words[r["row"], r["epoch"]] += r["words"]
    assert sum(words.values()) == sum(quota.values())


def test_mixed_documents(spark, docs):
    for df in (docs, brute.awkward(spark)):
        got = mixing.mixed_documents(df)
        assert got.columns == df.columns
        words = sum(len(brute.WORD.findall(r["text"])) for r in got.collect())
        assert words == sum(r["taken"] for r in mixing.Mix(df).taken().collect())


def test_mixed_documents_come_in_the_order_of_the_schedule(spark, docs, tmp_path):
    """What is written comes by slot, so that its first part has the target shares already."""
    mix = mixing.Mix(docs)
    slots = sorted((r["slot"], r["doc_id"], r["epoch"]) for r in mix.placed().collect())
    mixing.mixed_documents(docs).write.parquet(f"{tmp_path}/mixed")
    files = sorted((tmp_path / "mixed").glob("part-*.parquet"))
    rows = [r for f in files for r in pq.read_table(f).to_pylist()]
    assert [r["doc_id"] for r in rows] == [i for _, i, _ in slots]
    target = {r["source"]: r["target"] for r in mix.sources.collect()}
    words, whole = Counter(), sum(target.values())
    for k, r in enumerate(rows):
        words[r["source"]] += len(brute.WORD.findall(r["text"]))
        if k == len(rows) // 2:
            so_far = sum(words.values())
            longest = max(len(brute.WORD.findall(x["text"])) for x in rows)
            assert all(abs(words[x] - so_far * target[x] / whole) <= longest + 8 * mix.block for x in target)


def test_maps_in_other_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", {"k": "v"}), (2, "c d e", "s", None)], "doc_id long, text string, source string, extra map<string,string>")
    assert mixing.mixed_documents(df).columns == df.columns and mixing.Mix(df).taken().count() == 2


# packing


def check_packing(rows, most=2048):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at <= most
    return len(by)


def test_pack(spark, docs, texts):
    slow = Tokenizer.from_file(packing.vocabulary())
    rows = packing.pack(docs).collect()
    n = check_packing(rows)
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for doc, text in texts.items():
        ids = np.array([*slow.encode(text, add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k, r in enumerate(sorted(by[doc], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert k == 0 or r["length"] == 2048
            at += r["length"]
        assert at == len(ids) and (len(ids) > 2048 or len(by[doc]) == 1)


def test_pack_edges(spark):
    df = brute.awkward(spark)
    rows = packing.pack(df).collect()
    check_packing(rows)
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(i for i, _ in pairs(df))
    assert [r["length"] for r in rows if r["doc_id"] == 4] == [1]
    assert packing.pack(brute.empty(spark)).count() == 0
    slow = Tokenizer.from_file(packing.vocabulary())
    for t in ("<|endoftext|> inside", "a<|endoftext|>", "émoji 🙂", "x" * 3000, " \n\n\t  z", "don't We'LL 12³½"):
        assert packing.encoder(packing.vocabulary())(t) == np.array(slow.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_evolution_only_gains():
    rng = np.random.default_rng(4)
    sizes = np.sort(rng.integers(300, 1200, 400))[::-1].copy()
    start = packing._decreasing(sizes, np.arange(len(sizes)), 2048)
    best = packing.evolve(sizes, [], 1, 2048, 30)[0]
    assert np.bincount(best, sizes).max() <= 2048 and len(best) == len(sizes)
    assert packing._worth(sizes, best, 2048) <= packing._worth(sizes, start, 2048)
    again = packing.evolve(sizes, [], 1, 2048, 30)[0]
    assert (best == again).all()


def test_crossover_keeps_whole_sequences():
    rng = np.random.default_rng(5)
    sizes = np.full(64, 1024)
    a, b = np.repeat(np.arange(32), 2).astype(np.int32), np.tile(np.arange(32), 2).astype(np.int32)
    child = packing.crossover(sizes, a, b, rng, 2048)
    groups = defaultdict(set)
    for k, c in enumerate(child.tolist()):
        groups[c].add(k)
    whole = {frozenset({k, k + 32}) for k in range(32)}
    assert sum(frozenset(g) in whole for g in groups.values()) >= 8
    assert np.bincount(child, sizes).max() <= 2048


def test_no_python_in_native_plans(spark, docs):
    for df in (line_dedup.line_dedup(docs), quality_rules.quality_report(docs), mixing.Mix(docs).taken()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_queries_are_registered():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
    assert json.dumps(sorted(queries.oracle_sql()))
