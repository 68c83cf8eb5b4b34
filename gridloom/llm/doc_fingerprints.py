"""Document fingerprints: SimHash of weighted terms, and permuted block tables that find all fingerprints
within a Hamming radius.

Only DataFrame functions. Terms are words and pairs of words; each votes with its weight on 128 signed bits.
Words are exploded only into a partial aggregation by row, so what is shuffled is a row of vote sums for
each row, never its words. A search compares only fingerprints that share a block key: equal fingerprints
are one row, and each key is hashed from enough bits to stay selective at any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm._common import SPACE, Scratch, documents
from gridloom.llm._simhash import distance, fingerprint, tables, votes

BITS = 128
#: Weights of a term that is a pair of words, and of one that is a single word.
PAIR, SINGLE = 4, 1
#: 7 blocks with keys of 2 find all fingerprints that differ in up to 5 bits.
BLOCKS, CHOSEN = 7, 2
RADIUS = BLOCKS - CHOSEN
#: Ranges of ids within which neighbouring documents are found are cut so that one holds about RANGE rows; their
#: bounds, one for each range, reach the driver. They are looked up in two steps of FAN or more, of MOST_FAN at most,
#: so that at any size there are some sixteen thousand bounds; ranges of very many rows are sorted on disk.
FAN, MOST_FAN, RANGE = 32, 128, 4096


def fingerprints(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, fp0, fp1): the 128-bit SimHash of the text of each value of the column key, as two longs.

    Terms are lower-cased words and adjacent pairs of them, each as often as it comes. Texts without words
    and null texts have the fingerprint 0. Rows that share a key have the same text, such as rows with its
    hash; each votes by itself, so votes don't grow with the number of copies. A null key is a key.
    """
    clean = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = df.select(key, F.monotonically_increasing_id().alias("__row"), F.filter(F.split(clean, SPACE + "+"), lambda x: x != "").alias("__w"))
    hashes = words.select(key, "__row", F.transform("__w", lambda x: F.xxhash64(x)).alias("__w"))
    terms = hashes.select(key, "__row", "__w", F.posexplode_outer("__w").alias("__i", "__x")).select(key, "__row", "__x", F.get("__w", F.col("__i") - 1).alias("__y"))
    pair = lambda seed: F.when(F.col("__y").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "__y", "__x"))
    single = lambda seed: F.when(F.col("__x").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "__x"))
    terms = terms.select(key, "__row", single(1).alias("s0"), single(2).alias("s1"), pair(3).alias("p0"), pair(4).alias("p1"), (F.when(F.col("__x").isNull(), 0).otherwise(SINGLE) + F.when(F.col("__y").isNull(), 0).otherwise(PAIR)).alias("weight"))
    sums = [v for word in (0, 1) for v in votes([(f"s{word}", SINGLE), (f"p{word}", PAIR)], word)]
    summed = terms.groupBy(key, "__row").agg(F.sum("weight").alias("total"), *sums)
    prints = summed.select(key, *[fingerprint("total", word).alias(f"fp{word}") for word in (0, 1)])
    return prints.groupBy(key).agg(F.min("fp0").alias("fp0"), F.min("fp1").alias("fp1"))


def likeness(left: list[str], right: list[str]) -> Column:
    """The share of bits on which two fingerprints agree."""
    return (BITS - distance([F.col(c) for c in left], [F.col(c) for c in right])) / F.lit(float(BITS))


def neighbours(index: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All fingerprints of index within radius of those of queries: (q0, q1, fp0, fp1, n, distance).

    Both have fp0 and fp1; equal rows of index are one, with their number n. Every fingerprint of index is
    in each table under the key of its blocks; a query looks its own keys up, and a pair that meets in more
    than one table is listed once. radius is at most RADIUS, up to which the tables are complete.
    """
    if radius > RADIUS:
        raise ValueError(f"the tables find all up to {RADIUS} bits")
    every = index.groupBy("fp0", "fp1").agg(F.count("*").alias("n"))
    every = every.select("fp0", "fp1", "n", F.explode(tables(["fp0", "fp1"], BLOCKS, CHOSEN)).alias("key"))
    asked = queries.select(F.col("fp0").alias("q0"), F.col("fp1").alias("q1")).distinct()
    asked = asked.select("q0", "q1", F.explode(tables(["q0", "q1"], BLOCKS, CHOSEN)).alias("key"))
    apart = distance([F.col("fp0"), F.col("fp1")], [F.col("q0"), F.col("q1")])
    met = asked.join(every, "key").withColumn("distance", apart).where(F.col("distance") <= radius)
    return met.select("q0", "q1", "fp0", "fp1", "n", "distance").distinct()


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, sha) with next_sha and next_text, those of the next document by (doc_id, sha); after
    the last comes the first. A null id comes first; of equal rows each but the last has the next of them.

    Ids are cut into ranges at quantiles; a range is one window, with a copy of the first document of the
    next range as its last row. So nothing is sorted in one place, and a text moves once.
    """
    fan = min(MOST_FAN, max(FAN, math.isqrt(docs.count() // RANGE) + 1))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / fan**2 for k in range(1, fan**2)], 20 * fan**2)).first()[0] or [0]
    cuts = sorted(set(cuts))
    fine = [cuts[k : k + fan] for k in range(0, len(cuts), fan)]
    coarse = F.lit([part[0] for part in fine]).cast("array<bigint>")
    upto = lambda bounds: F.size(F.filter(bounds, lambda c: c <= F.col("doc_id")))
    lists = F.array(*[F.lit(part).cast("array<bigint>") for part in fine])
    part = docs.withColumn("__c", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(upto(coarse)))
    part = part.withColumn("__range", F.when(F.col("__c") == 0, F.lit(0)).otherwise((F.col("__c") - 1) * fan + upto(F.get(lists, F.col("__c") - 1)))).drop("__c")
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", "sha")).alias("first")
    found = part.groupBy("__range").agg(first).orderBy("__range").collect()  # a row for each range at most
    if not found:
        return docs.withColumns({"next_sha": F.lit(None).cast("string"), "next_text": F.lit(None).cast("string")})
    heads = docs.sparkSession.createDataFrame([(r["__range"], found[k - 1]["__range"], r["first"]["doc_id"], r["first"]["sha"]) for k, r in enumerate(found)], "__range int, __host int, __id bigint, __sha string")
    part = part.join(F.broadcast(heads), "__range")
    guest = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sha") == F.col("__sha"))
    own, other = F.struct(F.col("__range").alias("at"), F.lit(False).alias("guest")), F.struct(F.col("__host").alias("at"), F.lit(True).alias("guest"))
    spread = part.withColumn("__place", F.explode(F.when(guest, F.array(own, other)).otherwise(F.array(own))))
    order = Window.partitionBy("__place.at").orderBy("__place.guest", F.col("doc_id").asc_nulls_first(), "sha")
    out = spread.withColumns({"next_sha": F.lead("sha").over(order), "next_text": F.lead("text").over(order), "__guest": F.col("__place.guest")})
    return out.where("NOT __guest").drop("__range", "__host", "__id", "__sha", "__place", "__guest")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """For each row of docs (doc_id, text) its fingerprint, its edited text's and the next document's, with their
    likenesses and, where doc_id is divisible by 100, n_near: the documents within RADIUS, itself included.

    The edited text has the last half of its code points (rounded down) replaced by the first as many, or
    all, of the next document's. Null texts are empty. A null id is compared as the first document.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    nexts = with_next(plain).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    made = nexts.select("doc_id", "n_chars", "sha", "next_sha", edited.alias("edited"))
    with Scratch() as stage:  # edited texts and single prints go when rows has what is needed of them
        made = stage(made.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)))
        texts = plain.select("sha", "text").unionByName(made.select(F.col("edited_sha256").alias("sha"), F.col("edited").alias("text")))
        prints = stage(fingerprints(texts, "sha"))
        named = lambda name, a, b: prints.select(F.col("sha").alias(name), F.col("fp0").alias(a), F.col("fp1").alias(b))
        rows = made.drop("edited").join(named("sha", "fp0", "fp1"), "sha").join(named("edited_sha256", "e0", "e1"), "edited_sha256").join(named("next_sha", "n0", "n1"), "next_sha")
        rows = stage.keep(rows.select("doc_id", "n_chars", "edited_sha256", "fp0", "fp1", "e0", "e1", "n0", "n1"))
    asked = rows.where("doc_id % 100 = 0")
    near = neighbours(rows, asked).groupBy(F.col("q0").alias("fp0"), F.col("q1").alias("fp1")).agg(F.sum("n").alias("n_near"))
    answered = asked.join(near, ["fp0", "fp1"], "left").select(*rows.columns, "n_near")
    rest = rows.where("doc_id IS NULL OR doc_id % 100 <> 0").withColumn("n_near", F.lit(None).cast("long"))
    text = lambda a, b: F.lower(F.concat(F.lpad(F.hex(b), 16, "0"), F.lpad(F.hex(a), 16, "0")))
    return answered.unionByName(rest).select(
        "doc_id", "n_chars", "edited_sha256", text("fp0", "fp1").alias("fingerprint"), text("e0", "e1").alias("edited_fingerprint"),
        likeness(["fp0", "fp1"], ["e0", "e1"]).alias("near_edited"), likeness(["fp0", "fp1"], ["n0", "n1"]).alias("near_next"), "n_near",
    )


def op10_doc_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and the neighbours of every hundredth."""
    return edited_pairs(documents(spark, sf_dir))


QUERIES = {"op10_doc_fingerprints": op10_doc_fingerprints}
