"""The inverted index: postings, terms, chunks and corpus statistics as tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.config import RankingConfig
from spanloom.functions import text as T
from spanloom.operators.scale import spread, top_rows
from spanloom.session import unsorted_folders

# Deepest ranking that the stored role heads can serve.
HEAD_ROWS = 1_000
# Postings of one shard of chunks, and terms of one bucket of the vocabulary. A shard is sorted by one
# task, at about 180 bytes for each posting: so many stay in memory.
POSTINGS_PER_SHARD = 1_000_000
MAX_SHARDS = 100_000
TERMS_PER_BUCKET = 5_000_000
MAX_BUCKETS = 4_096
# Folders of the chunk table; a chunk's folder follows from its number.
CHUNK_PARTS = 1_024


def label(symbol: Column, section_title: Column) -> Column:
    """The name a chunk goes by: its symbol, else its section title."""
    return T.first_filled(symbol, section_title)


def evidence_key() -> Column:
    """Sixteen bytes of SHA-256 that stand for (repository, path, label); a null label is a label.

    Search results are reduced by it, so that paths and labels need not travel
    with every candidate.
    """
    sized = [F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in ("repository", "source_path", "label")]
    return F.substring(F.unhex(F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("-")) for c in sized]), 256)), 1, 16)


def analyzed(chunks: DataFrame, config: RankingConfig) -> DataFrame:
    """Chunks with their sorted tokens and the terms that boosts look at."""
    name = F.coalesce(label(F.col("symbol"), F.col("section_title")), F.lit(""))
    searchable = T.searchable_text(
        F.col("content"), F.col("symbol"), F.col("source_path"), F.col("source_role"),
        F.col("repository"), F.col("section_title"), F.col("parent_context"),
        config.index_null_symbol,
    )
    # Transforms over one element bind a value to a name, so that it is computed once.
    symbol = F.get(F.transform(
        F.array(F.struct(name.alias("name"), T.canonical(name).alias("canonical"))),
        lambda n: F.struct(
            n["name"].alias("name"), n["canonical"].alias("canonical"),
            F.array_distinct(F.filter(
                T.tokenize(n["name"]), lambda t: (F.length(t) >= 3) & (t != n["canonical"])
            )).alias("words"),
        ),
    ), F.lit(0))
    # What the tokens use more than once is a column of its own, which Spark doesn't copy.
    spaced = chunks.withColumn("_spaced", T.spaced_words(searchable)).withColumn("_lowered", F.lower("_spaced"))
    return spaced.select(
        "chunk_id", "repository", "source_role", "source_path",
        "chunk_type", "start_line", "end_line",
        symbol.alias("symbol"),
        F.array_distinct(T.tokenize(F.col("source_path"))).alias("path_terms"),
        # sort_array, as array_sort compares through an interpreted lambda.
        F.sort_array(T.bag_of(F.col("_spaced"), F.col("_lowered"))).alias("tokens"),
    ).select(
        "*",
        F.nullif("symbol.name", F.lit("")).alias("label"),
        F.col("symbol.canonical").alias("canonical_symbol"),
        F.col("symbol.words").alias("symbol_terms"),
        F.size("symbol.words").alias("symbol_words"),
    ).drop("symbol").withColumn("evidence_key", evidence_key())


def term_counts(sorted_tokens: Column) -> Column:
    """Run lengths of a sorted token array as (term, tf) structs, without a shuffle."""
    size = F.size(sorted_tokens)
    # 1-based starts of the runs, and the end of the last one.
    edges = F.filter(
        F.sequence(F.lit(1), size + 1),
        lambda i: (i == 1) | (i == size + 1)
        | (F.get(sorted_tokens, i - 1) != F.get(sorted_tokens, i - 2)),
    )

    def runs(at: Column) -> Column:
        return F.transform(
            F.slice(at, F.lit(1), F.size(at) - 1),
            lambda start, i: F.struct(
                F.get(sorted_tokens, start - 1).alias("term"), (F.get(at, i + 1) - start).alias("tf")
            ),
        )

    # The outer transform only binds `edges` to a name, so that it runs once.
    return F.flatten(F.transform(F.array(edges), runs))


def postings(chunks: DataFrame) -> DataFrame:
    """One row per distinct term of a chunk: tf, chunk length and boost flags.

    A chunk's tokens lie in one row, so they are counted there: nothing is
    shuffled. The flags say whether the term is the chunk's whole symbol, one of
    its symbol words, or in its path, so that one pass over the postings of a
    query's terms yields the boosts as well as the lexical score. The canonical
    symbol is added with tf 0 where it is no token of its chunk.
    """
    term = F.col("p.term")
    is_symbol = term == F.col("canonical_symbol")
    extra = F.when(
        (F.length("canonical_symbol") >= 4) & ~F.array_contains("tokens", F.col("canonical_symbol")),
        F.array(F.struct(F.col("canonical_symbol").alias("term"), F.lit(0).alias("tf"))),
    ).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))
    return (
        chunks.withColumn("p", F.explode(F.concat(term_counts(F.col("tokens")), extra)))
        .select(
            term.alias("term"), "chunk_no", "p.tf", "length",
            is_symbol.alias("is_symbol"),
            F.array_contains("symbol_terms", term).alias("in_symbol"),
            F.array_contains("path_terms", term).alias("in_path"),
        )
    )


def term_statistics(chunks: DataFrame) -> DataFrame:
    """Document frequency of each term. Chunks are counted before the shuffle."""
    return chunks.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(
        F.count("*").alias("df")
    )


def corpus_statistics(chunks: DataFrame) -> DataFrame:
    """One row: chunks, their average length (empty ones included) and postings."""
    return chunks.agg(
        F.count("*").alias("chunks"), F.avg("length").alias("avg_length"),
        F.coalesce(F.sum(F.size(F.array_distinct("tokens"))), F.lit(0)).alias("postings"),
    )


def idf(total: Column, df: Column) -> Column:
    return F.log(1.0 + (total - df + 0.5) / (df + 0.5))


def bm25(tf: Column, length: Column, avg_length: Column, weight: Column, config: RankingConfig) -> Column:
    """One term's contribution."""
    scale = config.k1 * (1.0 - config.b + config.b * length / avg_length)
    return weight * tf * (config.k1 + 1.0) / (tf + scale)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def part_of(chunk_no: Column) -> Column:
    """The folder of the chunk table that holds a chunk: by the task that numbered it."""
    return (F.shiftright(chunk_no, 33) % CHUNK_PARTS).cast("int")


@dataclass(frozen=True)
class LexicalIndex:
    """A built index: the path of its tables and how they are split."""

    path: str
    buckets: int
    shards: int

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        if name == "postings":
            return self._postings(spark)
        return spark.read.parquet(f"{self.path}/{name}")

    @property
    def postings_name(self) -> str:
        return f"spanloom_postings_{md5(self.path.encode()).hexdigest()}"

    def _postings(self, spark: SparkSession) -> DataFrame:
        """The postings as a bucketed table: Spark knows that the shards keep a chunk's postings together."""
        if not spark.catalog.tableExists(self.postings_name):
            columns = spark.read.parquet(f"{self.path}/postings").schema.toDDL()
            spark.sql(
                f"CREATE TABLE {self.postings_name} ({columns}) USING parquet CLUSTERED BY (chunk_no) SORTED BY (term, chunk_no) "
                f"INTO {self.shards} BUCKETS LOCATION '{self.path}/postings'"
            )
        return spark.table(self.postings_name)


def open_index(spark: SparkSession, path: str) -> LexicalIndex:
    stats = spark.read.parquet(f"{path}/statistics").first()
    return LexicalIndex(path, stats["buckets"], stats["shards"])


def build_index(chunks: DataFrame, path: str, config: RankingConfig) -> LexicalIndex:
    """Write the index tables under `path` and return a handle.

    `chunks/` is written first, with the tokens of each chunk, and every other
    table is derived from it, so that the text is read and analysed once.
    `chunk_no` is unique and fixed once the chunks are written.

    Postings lie in shards by a hash of the chunk, sorted by term inside. The
    chunks are shuffled to their shards as rows, before they are taken apart, so
    no posting is shuffled, no range is sampled, and a common term is spread
    over all shards. All postings of a chunk meet in one task without exchange.
    The vocabulary lies in buckets by a hash of the term, sorted inside.
    """
    spark = chunks.sparkSession
    numbered = analyzed(spread(chunks), config).withColumn("chunk_no", F.monotonically_increasing_id())
    numbered = numbered.withColumn("part", part_of(F.col("chunk_no")))
    with unsorted_folders(spark):
        numbered.write.partitionBy("part").parquet(f"{path}/chunks")
    stored = spark.read.schema(numbered.schema).parquet(f"{path}/chunks").withColumn("length", F.size("tokens"))
    stats = corpus_statistics(stored).first()
    if not stats["chunks"]:
        raise ValueError("The corpus is empty.")
    buckets = max(1, min(MAX_BUCKETS, -(-stats["postings"] // TERMS_PER_BUCKET)))
    cores = spark.sparkContext.defaultParallelism
    shards = min(MAX_SHARDS, max(cores, -(-stats["postings"] // POSTINGS_PER_SHARD)))
    index = LexicalIndex(path, buckets, shards)
    spark.createDataFrame(
        [(stats["chunks"], float(stats["avg_length"]), buckets, shards)], "chunks long, avg_length double, buckets int, shards int"
    ).coalesce(1).write.parquet(f"{path}/statistics")

    def sharded() -> None:
        columns = ["chunk_no", "tokens", "length", "canonical_symbol", "symbol_terms", "path_terms"]
        rows = postings(stored.select(*columns).repartition(shards, "chunk_no"))
        rows.write.bucketBy(shards, "chunk_no").sortBy("term", "chunk_no").option("path", f"{path}/postings").saveAsTable(index.postings_name)

    def vocabulary() -> None:
        terms = term_statistics(stored).withColumn("bucket", bucket_of(F.col("term"), buckets))
        terms.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/terms")

    def heads() -> None:
        evidence_heads(stored, HEAD_ROWS).write.parquet(f"{path}/heads")
        role_heads(spark.read.parquet(f"{path}/heads"), HEAD_ROWS).write.parquet(f"{path}/role_heads")

    jobs = [sharded, vocabulary, heads]
    # Independent of each other: run side by side, so that none leaves cores idle.
    with ThreadPoolExecutor(len(jobs)) as pool:
        for job in [pool.submit(job) for job in jobs]:
            job.result()
    return index


def evidence_heads(chunks: DataFrame, limit: int) -> DataFrame:
    """First `limit` evidence keys by chunk id of each (role, repository).

    A chunk that a query reaches only through its role or repository scores the
    same as every other such chunk of that role and repository, and ties go by
    chunk id. So a top-k with k <= limit needs no more of them than these.
    """
    key = ["source_role", "repository", "source_path", "label"]
    first = top_rows(chunks.select("chunk_id", "chunk_no", *key), key, [F.col("chunk_id")], 1, "_first")
    return top_rows(
        first.drop("_first", "source_path", "label"),
        ["source_role", "repository"], [F.col("chunk_id")], limit, "head_rank",
    )


def role_heads(heads: DataFrame, limit: int) -> DataFrame:
    """The same per role alone."""
    return top_rows(heads.drop("head_rank"), ["source_role"], [F.col("chunk_id")], limit, "head_rank")
