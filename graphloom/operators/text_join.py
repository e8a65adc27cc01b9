"""Texts that hold other texts, found by hashed windows instead of comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, at the most; words' hashes up to which the items' side is broadcast.
WINDOW, BROADCAST = 5, 200_000


def contained(documents: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, doc_id of items whose text is part of a document's, character by character.

    Between its first and last space an item's words stand between spaces wherever it is held; a window of these is
    hash-joined to the documents' windows, and what meets is compared.  Items of one or two words are looked for in every
    document; they are counted first and broadcast, or dealt out by rows where they are many."""
    own = items.select("item_id", F.col("text").alias("item")).where("item IS NOT NULL").withColumn("w", F.split("item", " ")).withColumn("inner", F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))))
    keyed = own.where(F.size("inner") > 0).withColumn("n", F.least(F.size("inner"), F.lit(WINDOW))).select("item_id", "item", "n", F.xxhash64(F.array_join(F.slice("inner", F.lit(1), F.col("n")), " ")).alias("h"))
    sizes = [r["n"] for r in keyed.select("n").distinct().collect()]  # WINDOW at the most
    docs = documents.select("doc_id", "text", F.split("text", " ").alias("w")).where("text IS NOT NULL")

    def windows(n: int) -> Column:
        last = F.size("w") - n
        places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, n), " "))))

    out = None
    for n in sizes:
        met = docs.select("doc_id", F.explode(windows(n)).alias("h"))
        few = keyed.where(F.col("n") == n)
        few = F.broadcast(few.select("h", "item_id")) if few.count() <= BROADCAST else few.select("h", "item_id")
        part = met.join(few, "h").select("item_id", "doc_id").distinct()
        out = part if out is None else out.unionByName(part)
    if out is not None:
        held = out.join(items.select("item_id", F.col("text").alias("item")), "item_id").join(documents.select("doc_id", "text"), "doc_id").where(F.contains("text", F.col("item")))
        out = held.select("item_id", "doc_id")
    short = own.where(F.size("inner") == 0).select("item_id", "item")
    n = short.count()
    if n:  # a stated, small set of items against all documents
        if n > BROADCAST:
            raise ValueError(f"{n} items of one or two words")
        listed = short.agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
        part = docs.join(F.broadcast(listed), F.lit(True)).select("doc_id", "text", F.explode(F.filter("items", lambda x: F.contains(F.col("text"), x["item"]))).alias("x")).select("x.item_id", "doc_id")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else own.join(docs.select("doc_id"), F.lit(False)).select("item_id", "doc_id")
