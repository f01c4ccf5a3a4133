"""Secret scan with a random forest that removes false positives.

Candidates are long runs of the characters keys are written in.  Each is described
by its length and character classes, the transitions between them, the share of it
that dictionary words cover, hints in its path, and the words beside it.  A random
forest trained from labelled findings tells secrets from other long strings.
DataFrame operations and Spark's own forest only.

Findings are given by place and digest, not in clear.

Defined results: a null or empty text has no candidates; a candidate found several
times in a text is a finding at each place, judged by what is beside it there; an
equals sign within a run assigns, so what follows it is a candidate of its own (one
or two at the end are padding and belong to it); repeated rows are searched each; a null
path gives no hints; without labelled findings of both kinds every score is the share of
secrets among the labels, or 0.5 without any.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import small, stage


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled findings learned from: those with the smallest
    hash.  Everything else covers all rows."""

    sample: int = 20_000
    trees: int = 30
    depth: int = 6
    seed: int = 7


#: runs this long are candidates: any, or those with a digit
LONG, LONG_WITH_DIGIT = 20, 12
_KEY, _PAD = r"[A-Za-z0-9+/_\-]", r"(?![A-Za-z0-9+/=_\-])"
#: looked for only where a run begins
_RUN = (
    rf"(?<!{_KEY})(?:{_KEY}{{{LONG_WITH_DIGIT},}}+(?:={{1,2}}{_PAD})?"
    rf"|{_KEY}{{{LONG_WITH_DIGIT - 1}}}={{1,2}}{_PAD}|{_KEY}{{{LONG_WITH_DIGIT - 2}}}=={_PAD})"
)
_NAMED = r"(?i)(?:token|secret|passw|pwd|api|auth|key|credential)"
_SAMPLE = r"(?i)(?:example|sample|dummy|test|placeholder|xxxx|fake)"
_BEFORE, _AFTER = 48, 24
#: a name and the sign that assigns, at the end of what is before a candidate
_ASSIGNS = r"""[A-Za-z0-9_.\-]*["']?\s*[=:]\s*["']?$"""
#: neighbouring words are told apart by the bucket of their hash
_BUCKETS = 16
#: features that define the labels of findings that label themselves
_DEFINING = ("f_named", "f_assigned", "f_quoted", "f_sample_near")


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """(doc_id, path, candidate, start, before, after): one row per place of a candidate.

    A text is cut once into runs and what lies between; the contexts are put together from
    the neighbouring pieces, and places are running sums of their lengths, so a text takes
    time in proportion to its length, however many candidates it has."""
    some = docs.select("doc_id", F.col(path).cast("string").alias("path"), "text").where(F.col("text").rlike(_RUN))
    # one more piece between the runs than there are runs
    runs, between = F.regexp_extract_all("text", F.lit(_RUN), F.lit(0)), F.split("text", _RUN)
    cut = some.select("doc_id", "path", F.monotonically_increasing_id().alias("text_number"), runs.alias("runs"), between.alias("between"))

    def entry(run: Column, i: Column) -> Column:
        run_at, between_at = lambda k: F.get("runs", i + k), lambda k: F.get("between", i + k)
        # so many runs are longer than the context
        back, on = -(-_BEFORE // LONG_WITH_DIGIT), -(-_AFTER // LONG_WITH_DIGIT)
        before = [piece for k in range(-back, 0) for piece in (run_at(k), between_at(k + 1))]
        after = [piece for k in range(1, on + 1) for piece in (between_at(k), run_at(k))]
        return F.struct(
            run.alias("candidate"),
            F.right(F.concat_ws("", *before), F.lit(_BEFORE)).alias("before"),
            F.left(F.concat_ws("", *after), F.lit(_AFTER)).alias("after"),
            (F.length(between_at(0)) + F.length(run)).alias("step"),
        )

    numbered = cut.select("doc_id", "path", "text_number", F.posexplode(F.transform("runs", entry)).alias("number", "entry"))
    each = numbered.select("doc_id", "path", "text_number", "number", "entry.*")
    # a group is the candidates of one text
    end = F.sum("step").over(Window.partitionBy("text_number").orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
    n = F.length("candidate")
    each = each.withColumn("start", (end - n).cast("int"))
    each = each.where((n >= LONG) | ((n >= LONG_WITH_DIGIT) & F.col("candidate").rlike("[0-9]")))
    return each.select("doc_id", "path", "candidate", "start", "before", "after")


def _count(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)).cast("double")


def described(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Candidates with their features; ``dictionary`` has a column ``word``."""
    n = F.length("candidate").cast("double")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    features = {
        "f_length": n,
        "f_distinct": F.size(F.array_distinct(F.split("candidate", ""))) / n,
        "f_digits": _count("[0-9]") / n,
        "f_lower": _count("[a-z]") / n,
        "f_upper": _count("[A-Z]") / n,
        "f_hex": flag(F.col("candidate").rlike("^[0-9a-fA-F]+$")),
        "f_to_digit": _count("[A-Za-z](?=[0-9])") / n,
        "f_to_letter": _count("[0-9](?=[A-Za-z])") / n,
        "f_case": _count("[a-z](?=[A-Z])") / n,
        "f_vowels": _count("(?i)[aeiou]") / n,
        "f_path_sample": flag(F.col("path").rlike(_SAMPLE)),
        "f_named": flag(F.col("before").rlike(_NAMED)),
        "f_assigned": flag(F.col("before").rlike(r"[=:]\s*[\"']?$")),
        "f_quoted": flag(F.col("after").rlike("^[\"']")),
        "f_sample_near": flag(F.concat("before", "after").rlike(_SAMPLE)),
    }
    # the words beside it, without the name it is assigned to
    beside = F.concat_ws(" ", F.regexp_replace("before", _ASSIGNS, " "), "after")
    buckets = F.transform(F.regexp_extract_all(F.lower(beside), F.lit(r"\p{L}{2,}"), F.lit(0)), lambda w: F.pmod(F.xxhash64(w), F.lit(_BUCKETS)))
    found = found.withColumn("_buckets", buckets).withColumn("_key", F.unhex(F.md5(F.col("candidate").cast("binary"))))
    features |= {f"f_beside_{k}": F.array_contains("_buckets", F.lit(k).cast("long")).cast("double") for k in range(_BUCKETS)}
    # the words of a candidate are looked up once, wherever and however often it is found
    split = F.explode_outer(F.expr("regexp_extract_all(lower(candidate), '[a-z]{4,}', 0)")).alias("word")
    inside = found.select("_key", "candidate").dropDuplicates(["_key"]).select("_key", F.length("candidate").alias("length"), split)
    words = dictionary.select(F.lower("word").alias("word")).where(F.length("word") >= 4).distinct().withColumn("known", F.lit(True))
    joined = inside.join(small(stage(words, "dictionary")), "word", "left")
    covered = F.sum(F.when(F.col("known"), F.length("word")).otherwise(0)) / F.first("length").cast("double")
    shares = stage(joined.groupBy("_key").agg(covered.alias("f_dictionary")), "covered")
    whole = found.withColumns(features).join(small(shares), "_key")
    return whole.select(*[c for c in found.columns if c not in ("_key", "_buckets")], *features, "f_dictionary")


def features_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.startswith("f_")]


def labelled(rows: DataFrame) -> DataFrame:
    """Findings that label themselves by what stands before them: a value assigned to a
    name that says so is a secret (1); one that is assigned to nothing, with no such name
    before it, counts as none until the forest says otherwise (0).  All others, and values
    beside words such as ``example``, are left out.  No feature that says any of this may be
    learned from these labels."""
    named, assigned = F.col("f_named") > 0, F.col("f_assigned") > 0
    label = F.when(F.col("f_sample_near") > 0, None).when(named & assigned, 1.0).when(~named & ~assigned, 0.0)
    return rows.withColumn("label", label).where("label is not null")


def scored(rows: DataFrame, findings: DataFrame, settings: Settings = Settings(), without: Sequence[str] = (), open_zeros: bool = False) -> DataFrame:
    """``rows`` with ``score``, by a forest trained on ``findings`` (features, label), that
    does not see the features ``without``.

    ``open_zeros``: a label of 0 only says that nothing speaks for a secret.  The forest
    then tells how likely a finding is to have the label 1; that, divided by how likely
    it is for those that have it, is how likely it is to be a secret."""
    names = [c for c in features_of(rows) if c not in without]
    order = [F.xxhash64("candidate", "before"), *names, "label"]
    sample = stage(findings.select("candidate", "before", *names, "label").orderBy(*order).limit(settings.sample), "labelled")
    count, mean, low, high = sample.agg(F.count("*"), F.avg("label"), F.min("label"), F.max("label")).first()
    if not count or low == high:
        return rows.withColumn("score", F.lit(0.5 if not count else float(mean)))
    to_vector = VectorAssembler(inputCols=names, outputCol="_features")
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="label", numTrees=settings.trees, maxDepth=settings.depth, seed=settings.seed, probabilityCol="_p"
    )
    model = forest.fit(to_vector.transform(sample).coalesce(8))
    chance = F.get(vector_to_array("_p"), F.lit(1))
    whole = 1.0
    if open_zeros:
        whole = model.transform(to_vector.transform(sample.where("label = 1"))).agg(F.avg(chance)).first()[0]
    judged = model.transform(to_vector.transform(rows))
    return judged.withColumn("score", F.least(chance / F.lit(float(whole)), F.lit(1.0))).select(*rows.columns, "score")


def scan(docs: DataFrame, dictionary: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, start, length, digest, score, is_secret) of every candidate."""
    rows = stage(described(stage(candidates(docs), "candidates"), dictionary), "described")
    judged = scored(rows, labelled(rows), without=_DEFINING, open_zeros=True) if findings is None else scored(rows, findings)
    return judged.select(
        "doc_id",
        F.col("start").cast("long").alias("start"),
        F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("digest"),
        "score",
        (F.col("score") >= threshold).alias("is_secret"),
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; the dictionary holds the words of the benchmark."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")
    dictionary = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(words)
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), dictionary)
