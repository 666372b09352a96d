r"""Mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating, and share 150 % of all words; none gets more
than twice its own words, and what it can't take is reshared by weight. That fixed point is closed-form: with sources
sorted by 2 S / w, and level_j = (1.5 S_all - caps before j) / (weights from j on), the common level is the largest
level_j, and a target is min(2 S, w * level).

Schedule: slot k carries the golden-ratio point u_k = frac(k * phi) in 31-bit fixed point; u_k falls into a source's
interval of the cumulated targets; the r-th slot of a source takes the r-th block of its stream. A stream is the
source's documents in the order of md5(doc_id), twice over, cut into blocks of the mean document's words; it ends at the
target, so the last block may be shorter. Blocks that the points leave over are appended, so that no source ends short.
The schedule is the order of the mix: `taken` gives each document its first slot and number of slots, and
`mixed_documents` writes the copies in the order of their first slots, so that any stretch of the output, and a training
run that stops early, has about the target shares. How many words a source gives in all follows from its target alone.

Scale. Ranks and running sums are two-level: within (source, chunk) and over the chunk totals, so a source with a third
of all rows is not one task. Slots meet source intervals by an equi-join on cells of the unit interval. The driver sees
four totals. Sources are ranked in one task (40 bytes each, which spill); copies are dealt to output partitions by slot, so
a partition holds about the same number of words whatever the source.

Defined cases: null text has no words and is not taken; ties in the order are told apart by id, size and a hash of the
row; repeated ids are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, n_words, row_hash, small, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
_UNIT = 1 << 31
_PHI = 1327217885  # phi * 2^31, odd
_CELL_BITS = 21
_CHUNK = 1 << 12  # slots ranked together at least; more where a source would have over 2^16 chunks


class Mix:
    """The plan of a mix over docs (doc_id, text, source): sources, schedule, stream pieces and documents."""

    def __init__(self, docs: DataFrame) -> None:
        spark = docs.sparkSession
        rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(text_of()).alias("size"), row_hash(docs).alias("th"))
        key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
        rows = cut(rows.withColumns({"key": key, "row": F.monotonically_increasing_id()}))

        per = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
        every = Window.partitionBy()
        per = per.withColumn("no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        per = per.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("no") - 1) % len(WEIGHTS) + 1).cast("long"))
        before = Window.orderBy(F.lit(MOST) * F.col("source_size") / F.col("w"), "no")
        caps = F.coalesce(F.sum(F.lit(MOST) * F.col("source_size")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = F.sum("w").over(before.rowsBetween(0, Window.unboundedFollowing))
        per = per.withColumn("level", (F.lit(SHARE) * F.sum("source_size").over(every) - caps) / left)
        per = per.withColumn("level", F.max("level").over(every))
        per = per.withColumn("target", F.least((F.lit(MOST) * F.col("source_size")).cast("double"), F.col("w") * F.col("level")))
        self.sources = cut(per.select("source", "no", "source_size", "n", "target", F.floor("target").alias("quota")))
        n, words, self.quota = self.sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("quota"), F.lit(0))).first()
        self.block = max(1, words // max(1, n))
        self.spark = spark

        known = rows.join(small(self.sources.select(F.col("source").alias("of"), "no", "source_size", "target", "quota"), 20_000), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        known = known.withColumn("chunk", F.substring("key", 1, 3))
        inside = Window.partitionBy("no", "chunk").orderBy("key", "doc_id", "size", "th", "row")
        known = known.withColumn("start", F.sum("size").over(inside) - F.col("size"))
        sums = rows.join(small(self.sources.select(F.col("source").alias("of"), "no"), 20_000), F.col("source").eqNullSafe(F.col("of"))).groupBy("no", F.substring("key", 1, 3).alias("chunk")).agg(F.sum("size").alias("s"))
        sums = sums.select("no", "chunk", (F.sum("s").over(Window.partitionBy("no").orderBy("chunk")) - F.col("s")).alias("offset"))
        placed = known.join(sums, ["no", "chunk"]).withColumn("start", F.col("start") + F.col("offset"))
        self.documents = cut(placed.select("doc_id", "source", "size", "th", "row", "no", "source_size", "target", "quota", "start"))

    def slots(self) -> int:
        """Slots that points are given to; those of blocks left over come after them."""
        return self.sources.agg(F.coalesce(F.sum(F.ceil(F.col("quota") / self.block)), F.lit(0))).first()[0]

    def schedule(self) -> DataFrame:
        """(slot, no: the source's number, block: from 1 within the source)."""
        counts = self.sources.select("no", "target", F.ceil(F.col("quota") / self.block).alias("blocks"))
        total = self.slots()
        upto = F.sum("target").over(Window.orderBy("no")) / F.sum("target").over(Window.partitionBy())
        last = F.max("no").over(Window.partitionBy())
        edges = counts.where("target > 0").select("no", "blocks", F.when(F.col("no") == last, F.lit(_UNIT)).otherwise(F.floor(upto * _UNIT)).cast("long").alias("high"))
        edges = edges.withColumn("low", F.lag("high", 1, 0).over(Window.orderBy("no"))).where("high > low")
        edges = edges.withColumn("cell", F.explode(F.sequence(F.shiftright("low", _CELL_BITS), F.shiftright(F.col("high") - 1, _CELL_BITS))))
        edges = cut(edges)
        points = self.spark.range(total).select(F.col("id").alias("slot"), ((F.col("id") % _UNIT) * _PHI % _UNIT).alias("u"))
        points = points.withColumn("cell", F.shiftright("u", _CELL_BITS))
        taken = points.join(small(edges), "cell").where("u >= low AND u < high").select("slot", "no", F.floor(F.col("slot") / max(_CHUNK, total >> 16)).alias("chunk"))
        sums = taken.groupBy("no", "chunk").agg(F.count(F.lit(1)).alias("n"))
        sums = cut(sums.select("no", "chunk", "n", (F.sum("n").over(Window.partitionBy("no").orderBy("chunk")) - F.col("n")).alias("offset")))
        ranked = taken.withColumn("rank", F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot"))).join(sums.drop("n"), ["no", "chunk"])
        ranked = ranked.select("slot", "no", (F.col("rank") + F.col("offset")).alias("block"))
        blocks = counts.select("no", "blocks")
        used = ranked.join(small(blocks, 20_000), "no").where("block <= blocks").select("slot", "no", "block")
        had = sums.groupBy("no").agg(F.sum("n").alias("had"))
        short = blocks.join(had, "no", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < blocks")
        rest = short.select("no", F.explode(F.sequence(F.col("had") + 1, F.col("blocks"))).alias("block"))
        return used.unionByName(rest.select((F.lit(total) + F.col("block") * (1 << 20) + F.col("no")).alias("slot"), "no", "block"))

    def copies(self) -> DataFrame:
        """documents once for each epoch that the mix reaches in them: with epoch, from (place in the stream), words (taken then, from the document's first word on)."""
        both = self.documents.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch")).withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
        return both.withColumn("words", F.least("size", F.col("quota") - F.col("from"))).where("words > 0")

    def pieces(self) -> DataFrame:
        """(slot, doc_id, row, epoch, first: word in the document, words): what each slot of the schedule holds."""
        b = F.lit(self.block)
        cut_up = self.copies().select("doc_id", "row", "no", "epoch", "from", "words", F.explode(F.sequence(F.floor(F.col("from") / b) + 1, F.floor((F.col("from") + F.col("words") - 1) / b) + 1)).alias("block"))
        begin = F.greatest(F.col("from"), (F.col("block") - 1) * b)
        end = F.least(F.col("from") + F.col("words"), F.col("block") * b)
        cut_up = cut_up.select("doc_id", "row", "no", "epoch", "block", (begin - F.col("from")).alias("first"), (end - begin).alias("words"))
        return cut_up.join(self.schedule(), ["no", "block"]).select("slot", "doc_id", "row", "epoch", "first", "words")

    def taken(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken, first_slot, n_slots) for every row; the slots are -1 and 0 if none of it is taken."""
        sums = self.pieces().groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
        none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return self.documents.join(sums, "row", "left").select("doc_id", "size", "source_size", "target", none("taken"), F.coalesce("first_slot", F.lit(-1)).cast("long").alias("first_slot"), none("n_slots"))

    def placed(self) -> DataFrame:
        """copies with the slot of their first word."""
        at = self.copies().withColumn("block", F.floor(F.col("from") / F.lit(self.block)) + 1)
        return at.join(self.schedule(), ["no", "block"])


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The columns of docs: a row for each copy that the mix takes of a document, in the order of the schedule; one that a
    target cuts ends with its last word taken."""
    mix = Mix(docs)
    th, id_, of, count, size, slot = fresh(docs, "row_hash", "copy_id", "copy_of", "copy_words", "copy_size", "copy_slot")
    texts = docs.withColumn(th, row_hash(docs))
    if mix.documents.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["doc_id", th])  # rows alike in every column; each is in copies by itself
    copies = cut(mix.placed().select(F.col("doc_id").alias(id_), F.col("th").alias(of), F.col("words").alias(count), F.col("size").alias(size), F.col("slot").alias(slot)))
    rows = texts.join(copies, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(of)))
    some = F.array_join(F.slice(F.split(text_of(), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), F.col(count).cast("int")), "")
    changed = F.col(count) < F.col(size)
    rows = rows.withColumn("text", F.when(changed, some).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    slots, parts = mix.slots(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor(F.least(F.col(slot), F.lit(max(0, slots - 1))) * parts / max(1, slots)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions(slot, "doc_id").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY source),
w AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS w FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w::DOUBLE, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
       / sum(w) OVER (ORDER BY 2 * source_size / w::DOUBLE, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, w::DOUBLE * max(level) OVER ()) AS target FROM l),
q AS (SELECT *, floor(target)::BIGINT AS quota FROM t),
k AS (SELECT greatest(1, sum(size) // count(*))::BIGINT AS block FROM d),
n AS (SELECT q.*, no, ceil(quota / block::DOUBLE)::BIGINT AS blocks, sum(ceil(quota / block::DOUBLE)::BIGINT) OVER () AS total FROM q JOIN s ON q.source IS NOT DISTINCT FROM s.source, k),
u AS (SELECT no, blocks, CASE WHEN no = max(no) OVER () THEN 2147483648 ELSE floor(sum(target) OVER (ORDER BY no) / sum(target) OVER () * 2147483648)::BIGINT END AS high FROM n WHERE target > 0),
iv AS (SELECT no, blocks, lag(high, 1, 0) OVER (ORDER BY no) AS low, high FROM u),
pt AS (SELECT slot, (slot % 2147483648) * 1327217885 % 2147483648 AS x FROM (SELECT unnest(range((SELECT max(total) FROM n)::BIGINT)) AS slot)),
ht AS (SELECT slot, no, blocks, row_number() OVER (PARTITION BY no ORDER BY slot) AS block FROM pt JOIN iv ON x >= low AND x < high),
sch AS (SELECT slot, no, block FROM ht WHERE block <= blocks
        UNION ALL SELECT total::BIGINT + b * 1048576 + no, no, b FROM (SELECT n.no, total, unnest(range(coalesce(had, 0) + 1, blocks + 1)) AS b FROM n LEFT JOIN (SELECT no, count(*) AS had FROM ht GROUP BY no) h ON n.no = h.no)),
p AS (SELECT row_number() OVER () AS r, doc_id, size, n.source_size, target, quota, no, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS c
      FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source),
e AS (SELECT *, c + turn * source_size AS start, least(size, quota - (c + turn * source_size)) AS words FROM p, range(2) x(turn)),
bl AS (SELECT r, no, unnest(range(start // block + 1, (start + words - 1) // block + 2)) AS block FROM e, k WHERE words > 0),
f AS (SELECT r, min(slot)::BIGINT AS first_slot, count(*) AS n_slots FROM bl JOIN sch USING (no, block) GROUP BY r)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(c + size, quota) - c) + greatest(0, least(c + source_size + size, quota) - (c + source_size)))::BIGINT AS taken, coalesce(first_slot, -1)::BIGINT AS first_slot, coalesce(n_slots, 0)::BIGINT AS n_slots
FROM p LEFT JOIN f USING (r)
"""
