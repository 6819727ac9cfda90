"""Threshold-scaled sketches of documents, in DataFrame functions only.

A text's five-word shingles are hashed to 64 bits, of which the upper 32 are
used; the sketch keeps every hash below a fixed fraction of the range, each
once. The same shingle is kept or left out in every text, so sketches can be
merged by union, and the share of a small text's sketch found in a large one's
estimates containment however unequal they are. A text with fewer than LEAST
hashes below the threshold keeps its LEAST smallest ones, or all it has; from
a sketch alone it is known up to where it is complete, and sketches are
compared up to where both are. A fingerprint is a hash of the whole text, then
the sorted sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphweft.llm.common import pick

WIDTH = 5
#: The fraction kept is 1 in 2 ** SHIFT.
SHIFT = 2
#: A sketch has so many hashes at least, where its text has.
LEAST = 8


def sketch(text: Column, width: int = WIDTH, shift: int = SHIFT) -> Column:
    """Sorted array of kept hashes. A text of fewer words is one shingle; so is one of none."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    top = F.lit(1 << (32 - shift))

    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - F.lit(width - 1), F.lit(1)))
        return F.transform(starts, lambda k: F.shiftrightunsigned(F.xxhash64(F.slice(w, k, width)), 32))

    def kept(hashes: Column) -> Column:
        below = F.array_distinct(F.sort_array(F.filter(hashes, lambda h: h < top)))
        pair = F.transform(F.array(below), lambda b: F.when(F.size(b) >= LEAST, b).otherwise(F.slice(F.array_distinct(F.sort_array(hashes)), 1, LEAST)))
        return pair[0]

    bound = F.transform(F.array(words), of)  # words and hashes are bound once, not made anew for each use
    return F.transform(bound, kept)[0]


def as_string(text: Column, kept: Column) -> Column:
    digits = F.transform(kept, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0"))
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0"), F.array_join(digits, ""))


def complete(kept: Column, shift: int = SHIFT) -> Column:
    """The hash below which a sketch has all hashes of its text."""
    return F.when(F.size(kept) < LEAST, F.lit(1 << 32)).otherwise(F.greatest(F.lit(1 << (32 - shift)), F.element_at(kept, -1) + 1))


def likeness(a: Column, b: Column, equal: Column, shift: int = SHIFT) -> Column:
    """Estimated share of common shingles among all. equal: whether the
    fingerprints' hashes of the whole texts are equal."""
    upto = F.least(complete(a, shift), complete(b, shift))
    n = lambda xs: F.size(F.filter(xs, lambda h: h < upto))
    both = n(F.array_intersect(a, b))
    all_ = n(a) + n(b) - both
    return F.when(equal, F.lit(1.0)).when(all_ == 0, F.lit(0.0)).otherwise(both / all_)


def containment(a: Column, b: Column, shift: int = SHIFT) -> Column:
    """Estimated share of a's shingles that b has; null where a has no hash up to where b is complete."""
    upto = complete(b, shift)
    own = F.filter(a, lambda h: h < upto)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own))


def merged(a: Column, b: Column, shift: int = SHIFT) -> Column:
    """The sketch of both texts together."""
    upto = F.least(complete(a, shift), complete(b, shift))
    return F.filter(F.sort_array(F.array_union(a, b)), lambda h: h < upto)


def fingerprints(docs: DataFrame, width: int = WIDTH, shift: int = SHIFT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sketch, fingerprint) of every text; null counts as empty."""
    rows = pick(docs, id_col, text_col).withColumn("sketch", sketch(F.col("text"), width, shift))
    return rows.select("doc_id", "sketch", as_string(F.col("text"), F.col("sketch")).alias("fingerprint"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, shift: int = SHIFT) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch): the next document by
    doc_id, then text; after the last comes the first.

    Documents are dealt to ranges whose bounds are doc_ids of the table, found
    from that column alone; the first document of a range is also sent to the
    range before, and the very first to the last, so each range finds its
    neighbours by itself and texts are shuffled once.
    """
    rows = pick(docs, id_col, text_col)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / n for k in range(1, n)] or [0.5]
    cuts, least, nulls = rows.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, shares)), 10_000), F.min("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    bounds = sorted(set(cuts or ()))
    step = max(1, int(len(bounds) ** 0.5))
    heads = bounds[::step]
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>")
    if bounds:  # two short scans: of every step-th bound, then of one step
        head = F.size(F.filter(array(heads), lambda b: b <= F.col("doc_id")))
        within = F.slice(array(bounds), F.greatest(head - 1, F.lit(0)) * step + 1, step)
        place = F.when(head > 0, (head - 1) * step + F.size(F.filter(within, lambda b: b <= F.col("doc_id"))))
        bucket = F.coalesce(place, F.lit(0))
        starts = F.col("doc_id").isin(bounds)
    else:
        bucket, starts = F.lit(0), F.lit(False)
    first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    to = lambda b, ghost, wrap: F.struct(b.alias("bucket"), F.lit(ghost).alias("ghost"), F.lit(wrap).alias("wrap"))
    places = F.array(
        to(F.col("own"), False, 0),
        F.when(starts, to(F.col("own") - 1, True, 0)),
        F.when(first, to(F.lit(len(bounds)), True, 1)),
    )
    dealt = rows.withColumn("own", bucket).select("doc_id", "text", F.explode(F.array_compact(places)).alias("to")).select("to.*", "doc_id", "text")
    placed = dealt.repartitionById(len(bounds) + 1, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "wrap", "doc_id", "text", "ghost").withColumn("sketch", sketch(F.col("text"), width, shift))
    order = Window.partitionBy("bucket").orderBy("wrap", "doc_id", "text", "ghost")
    following = placed.withColumn("next", F.lead(F.struct("text", "sketch")).over(order)).where(~F.col("ghost"))
    return following.select("doc_id", "text", "sketch", F.col("next.text").alias("next_text"), F.col("next.sketch").alias("next_sketch"))


def compare_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last
    quarter is the beginning of the next document, and their likeness.

    Null counts as empty; a single document follows itself; rows of one
    doc_id follow each other by text; an empty table gives no rows.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter)))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("text"), F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch"), F.xxhash64("text") == F.xxhash64("edited")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch"), F.xxhash64("text") == F.xxhash64("next_text")).alias("near_next"),
    )
