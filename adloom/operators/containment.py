"""Which texts hold which others, without trying every pair."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adloom.sources.stored import stored_parts


def _pieces(text: Column, n: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n))))


def containment_candidates(outer: DataFrame, inner: DataFrame, n: int = 3) -> DataFrame:
    """(o, i): pairs of distinct texts where outer may contain inner: outer has the piece of inner that fewest outer texts have.

    A text shorter than n is its own piece. An inner text with a piece that no outer text has meets nothing.
    """
    found = None
    for size in range(1, n + 1):
        pieces = outer.where(F.char_length("o") >= size).select("o", F.explode(_pieces(F.col("o"), size)).alias("piece"))
        own = inner.where(F.char_length("i") >= n if size == n else F.char_length("i") == size)
        counts = pieces.groupBy("piece").agg(F.count("*").alias("n"))
        rated = own.select("i", F.explode(_pieces(F.col("i"), size)).alias("piece")).join(counts, "piece", "left")
        rarest = rated.groupBy("i").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("best"))
        part = rarest.where("best.n > 0").select("i", F.col("best.piece").alias("piece")).join(pieces, "piece").select("o", "i")
        found = part if found is None else found.unionByName(part)
    return found


#: Bytes of wanted texts that go to every executor at a time.
SENT_BYTES = 16 << 20


def documents_holding(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, doc_id: every document (doc_id, text) whose text contains a wanted text (query_id, text); blank ones are held by
    none. Ids are unique.

    A wanted text of n blank-separated pieces has its inner pieces whole in a document that holds it, so texts of three
    pieces or more meet documents on the hash of up to three inner ones. They go to the documents, SENT_BYTES at a time, and
    are looked for where they meet: neither documents nor their hashes move. Shorter ones are looked for in the distinct
    pieces, or pairs of pieces, of all documents (by their rarest trigram); the texts of found pairs decide.
    """
    split = F.split("text", " ")
    wanted = texts.where("text <> ''").select("query_id", F.col("text").alias("wanted"), split.alias("pieces"), F.least(F.size(split), F.lit(5)).alias("n"))
    sizes = {r["n"]: r["bytes"] for r in wanted.groupBy("n").agg(F.sum(F.octet_length("wanted")).alias("bytes")).collect()}  # five at most
    if not sizes:
        return docs.where("false").select(F.lit(None).cast(texts.schema["query_id"].dataType).alias("query_id"), "doc_id")

    def windows(size: int) -> DataFrame:
        held = docs.select("doc_id", split.alias("pieces")).where(F.size("pieces") >= size)
        starts = F.sequence(F.lit(1), F.size("pieces") - size + 1)
        return held.select("doc_id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice("pieces", i, F.lit(size)), " ")))).alias("o"))

    def short(n: int) -> DataFrame:
        own = wanted.where(F.col("n") == n)
        held = containment_candidates(windows(n).select("o").distinct(), own.select(F.col("wanted").alias("i")).distinct()).where(F.contains("o", "i"))
        part = windows(n).select("doc_id", F.xxhash64("o").alias("key")).join(held.select(F.xxhash64("o").alias("key"), "i"), "key").join(own.select("query_id", F.col("wanted").alias("i")), "i")
        whole = part.select("query_id", "doc_id").distinct().join(wanted.select("query_id", "wanted"), "query_id").join(docs.select("doc_id", "text"), "doc_id")
        return whole.where(F.contains("text", "wanted")).select("query_id", "doc_id")

    def inner(own: DataFrame, size: int) -> DataFrame:
        key = lambda start: F.xxhash64(*[F.get("pieces", start + i) for i in range(size)])
        held = docs.select("doc_id", "text", split.alias("pieces")).where(F.size("pieces") >= size + 2)
        keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("pieces") - size - 1), key))
        met = held.select("doc_id", "text", F.explode(keys).alias("key")).join(F.broadcast(own.select("query_id", "wanted", key(F.lit(1)).alias("key"))), "key")
        return met.where(F.contains("text", "wanted")).select("query_id", "doc_id").distinct()

    def parts() -> Iterator[DataFrame]:
        for n in sorted(sizes):
            rounds = -(-sizes[n] // SENT_BYTES)
            for i in range(rounds if n > 2 else 1):
                yield short(n) if n < 3 else inner(wanted.where((F.col("n") == n) & (F.pmod(F.xxhash64("wanted"), F.lit(rounds)) == i)), n - 2)

    return stored_parts(parts(), "holding")
