"""Name search by posting lists of trigrams.

For every trigram of the lower-case and folded forms of a name there is one posting: the
key of what bears the name (again for another name that has it), and in which forms the trigram stands. A search takes the
postings of the rarest trigrams of the text it looks for, intersects them rarest first,
and verifies what is left by ``contains``, so results are those of a scan of all names.

Postings and names are stored by bucket, so a search opens the files of its trigrams and
of its candidates. What the driver looks up is bounded: one count per trigram of the
searched text, and the numbers of the buckets of the candidates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fieldlark.functions import text
from fieldlark.operators.triples import exists
from fieldlark.session import cut_lineage, using

LENGTH = 3
# a run may start at any letter, but not inside one of two UTF-16 units
RUN = r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(...))"
GRAM_BUCKETS = 64
MOST_BUCKETS = 4096
NAMES_A_BUCKET = 100_000
# bytes of a row group of names: long names are taken apart by as many tasks as there are groups
NAME_GROUP_BYTES = 16 << 20
# the rarest trigrams that are intersected; verification does the rest
MOST_GRAMS = 4

NAME_SCHEMA = "species string, kind string, name string, lower string, folded_compat string, folded_full string, bucket int"
POSTING_SCHEMA = "gram string, forms int, bucket int, species string, gram_bucket int"
COUNT_SCHEMA = "gram string, n long"
FORMS = ["lower", *[f"folded_{kind}" for kind in text.FOLDS]]


def letters(value: Column) -> Column:
    """The code points of a text."""
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def grams(letters: Column) -> Column:
    """The runs of three of an array of letters, repeated ones too; none for fewer or for null.

    *letters* should be a column and not an expression, which would be computed for every run.
    """
    runs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(letters) - LENGTH, F.lit(0))),
        lambda i: F.concat(*[F.get(letters, i + k) for k in range(LENGTH)]))
    return F.when(F.size(letters) >= LENGTH, runs).otherwise(F.array().cast("array<string>"))


def runs(value: Column) -> Column:
    """The different runs of three code points of a text, in one pass of compiled code; none for fewer."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(RUN), F.lit(1)))


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def bucket_count(rows: int) -> int:
    """Number of buckets for so many names, a power of two."""
    return min(MOST_BUCKETS, 1 << max(0, (rows // NAMES_A_BUCKET).bit_length()))


def posting_table(names: DataFrame, buckets: int) -> DataFrame:
    """(gram, forms, bucket, species): one row per name and trigram of it.

    *names* holds the compared forms (see ``queries.name_table``); *forms* has bit i set where the trigram stands in
    form i. A name is taken apart where it is read, so no posting is shuffled; those of a species with more names may
    come more than once, with other forms. Rows of a frequent trigram stay rows, no list of them is ever gathered.
    """
    # forms that are spelt alike are taken apart once
    lower, compat, full = (F.col(form) for form in FORMS)
    like_lower, full_like_lower, full_like_compat = compat.eqNullSafe(lower), full.eqNullSafe(lower), full.eqNullSafe(compat)
    none = F.array().cast("array<string>")
    taken = names.select(
        "species", (like_lower & full_like_lower).alias("_alike"), like_lower.alias("_1_like_0"),
        full_like_lower.alias("_2_like_0"), full_like_compat.alias("_2_like_1"),
        F.coalesce(runs(lower), none).alias("_0"),
        F.when(~like_lower, F.coalesce(runs(compat), none)).alias("_1"),
        F.when(~full_like_lower & ~full_like_compat, F.coalesce(runs(full), none)).alias("_2"))
    taken = taken.withColumn("_1", F.when(F.col("_1_like_0"), F.col("_0")).otherwise(F.col("_1")))
    taken = taken.withColumn("_2", F.when(F.col("_2_like_0"), F.col("_0")).when(F.col("_2_like_1"), F.col("_1")).otherwise(F.col("_2")))

    def rows(found: Column, forms: int) -> Column:
        return F.transform(found, lambda gram: F.struct(gram.alias("gram"), F.lit(forms).alias("forms")))

    every = (1 << len(FORMS)) - 1
    sets = [F.col(f"_{i}") for i in range(len(FORMS))]
    split = []  # what stands in these forms and in no other
    for forms in range(1, every + 1):
        inside = [found for i, found in enumerate(sets) if forms >> i & 1]
        outside = [found for i, found in enumerate(sets) if not forms >> i & 1]
        split.append(rows(reduce(F.array_except, outside, reduce(F.array_intersect, inside)), forms))
    postings = F.when(F.col("_alike"), rows(F.col("_0"), every)).otherwise(F.concat(*split))
    return taken.select("species", F.inline(postings)).select(
        "gram", "forms", bucket_of(F.col("species"), buckets).alias("bucket"), "species")


def count_table(postings: DataFrame) -> DataFrame:
    """(gram, n): postings of every trigram."""
    return postings.groupBy("gram").agg(F.count("*").alias("n"))


def write_index(names: DataFrame, path: str, buckets: int | None = None) -> int:
    """Store *names* by bucket, their postings by trigram and the counts, in new folders ``names``, ``postings``, ``grams``.

    Gives the number of buckets, which grows with the names unless it is given.
    """
    spark = names.sparkSession
    buckets = bucket_count(names.count()) if buckets is None else buckets
    # the forms are made behind the shuffle, which moves every name once
    write_by_bucket(names.select("species", "kind", "name"), buckets, ["species", "kind", "name"], f"{path}/names", text.forms(F.col("name")))
    names = spark.read.schema(NAME_SCHEMA).parquet(f"{path}/names")
    postings = posting_table(names, buckets).withColumn("gram_bucket", bucket_of(F.col("gram"), GRAM_BUCKETS))
    # a task writes its buckets side by side: neither shuffled nor sorted, postings take no disk but that of their files
    with using(spark, {"spark.sql.maxConcurrentOutputFileWriters": str(GRAM_BUCKETS)}):
        postings.write.partitionBy("gram_bucket").parquet(f"{path}/postings", compression="zstd")
    count_table(spark.read.schema(POSTING_SCHEMA).parquet(f"{path}/postings")).sortWithinPartitions("gram").write.parquet(f"{path}/grams")
    return buckets


def write_by_bucket(rows: DataFrame, buckets: int, order: list[str], path: str, more: Sequence[Column] = ()) -> None:
    """Store rows about species by bucket, with *more* columns made of theirs; a bucket that holds most of them is split
    over files."""
    rows.withColumn("bucket", bucket_of(F.col("species"), buckets)).hint("rebalance", "bucket").sortWithinPartitions(
        "bucket", *order).select("*", *more).write.option("parquet.block.size", NAME_GROUP_BYTES).partitionBy("bucket").parquet(
        path, compression="zstd")


class Found(NamedTuple):
    species: DataFrame
    buckets: list[int] | None  # where they are, or None for anywhere

    def only(self, table: DataFrame) -> DataFrame:
        """Rows of the found species; of a *table* stored by bucket only their buckets are read."""
        if self.buckets is not None and "bucket" in table.columns:
            table = table.where(F.col("bucket").isin(self.buckets))
        return exists(table, self.species)


class TrigramIndex(NamedTuple):
    names: DataFrame
    postings: DataFrame
    grams: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrigramIndex:
        schemas = {"names": NAME_SCHEMA, "postings": POSTING_SCHEMA, "grams": COUNT_SCHEMA}
        return cls(*[spark.read.schema(schema).parquet(f"{path}/{part}") for part, schema in schemas.items()])

    def candidates(self, part: str, form: str) -> DataFrame | None:
        """(bucket, species) of those whose *form* may contain *part*, which is in that form already.

        Null where the index cannot tell, because *part* has no trigram.
        """
        wanted = {part[i:i + LENGTH] for i in range(len(part) - LENGTH + 1)}
        if not wanted:
            return None
        counts = {r.gram: r.n for r in self.grams.where(F.col("gram").isin(sorted(wanted))).collect()}
        if len(counts) < len(wanted):
            return self.postings.select("bucket", "species").limit(0)
        bit = 1 << FORMS.index(form)
        found = None
        for gram in sorted(counts, key=lambda g: (counts[g], g))[:MOST_GRAMS]:
            hits = self.postings.where(
                (F.col("gram_bucket") == bucket_of(F.lit(gram), GRAM_BUCKETS)) & (F.col("gram") == gram)
                & (F.col("forms").bitwiseAND(bit) != 0)).select("bucket", "species")
            found = hits if found is None else hits.join(found, ["bucket", "species"], "left_semi")
        return found

    def find(self, name: str, fold: str = "compat", kinds: list[str] | None = None) -> Found:
        """The species with *name* in one of their names (of these *kinds*), as a scan of all names would find them.

        A *name* of fewer than three letters, in lower case or folded, has no trigram: then all names are read.
        """
        spark, form = self.names.sparkSession, f"folded_{fold}"
        typed, plain = spark.range(1).select(F.lower(F.lit(name)), text.fold_full(F.lit(name))).first()
        hit = F.col("lower").contains(typed) | F.col(form).contains(plain)
        if kinds is not None:
            hit = hit & F.col("kind").isin(kinds)
        by_form = [self.candidates(typed, "lower"), self.candidates(plain, form)]
        if any(found is None for found in by_form):
            return Found(self.names.where(hit).select("species").distinct(), None)
        found = cut_lineage(by_form[0].unionByName(by_form[1]).distinct(), "candidates")
        buckets = sorted(r.bucket for r in found.select("bucket").distinct().collect())
        here = self.names.where(F.col("bucket").isin(buckets) & hit)
        return Found(exists(here, found).select("species").distinct(), buckets)
