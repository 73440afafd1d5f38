"""Licence scan: a trained paragraph classifier, in DataFrame functions only.

A paragraph is a run of text between line breaks. Its features are indicators of pairs of
neighbouring words (lower case, letters and digits) that occur in the known licence statements. A
multinomial logistic regression learns one class per licence family and one for other
text from the statements, their parts, and at most ``OTHERS`` paragraphs of the corpus
that share fewer than two pairs with any statement. Its temperature is chosen on a fold kept out of
the fit; a paragraph whose best family stays under ``SURE`` after that is "unknown". A
prediction is confirmed when one of the family's statements covers, or is covered by, the
paragraph's pairs to the share ``COVER``.

A paragraph without any known pair has the intercepts' probabilities, which training
makes "other"; only paragraphs with one are summed up, with pairs counted before the shuffle.

Defined cases: NULL and empty texts have no paragraph; a known statement repeated in one
text is found in each paragraph; equal rows are one; texts that share an id are read as one text; rows
without id are found with a NULL id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gitstrata.llm.license_texts import STATEMENTS
from gitstrata.llm.store import written

OTHER, UNKNOWN = "other", "unknown"
OTHERS, SURE, COVER, MIN_PAIRS = 4000, 0.5, 0.6, 2
TEMPERATURES = (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0)
#: Bits of the filter on pairs; fixed, and a larger vocabulary only lets more pairs through.
FILTER_BITS = 16


def words(line: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+"), 0)


def pairs(codes: Column) -> Column:
    """Numbers of neighbouring word pairs, from the words' hashes."""
    return F.zip_with(
        F.slice(codes, 1, F.greatest(F.size(codes) - 1, F.lit(0))), F.slice(codes, 2, F.greatest(F.size(codes) - 1, F.lit(0))),
        lambda a, b: F.shiftleft(a, 1).bitwiseXOR(b),
    )


def grams(line: Column) -> Column:
    """Distinct pair numbers of a paragraph."""
    return F.array_distinct(pairs(F.transform(words(line), lambda w: F.xxhash64(w))))


def statements(spark: SparkSession) -> DataFrame:
    """``(family, statement, pairs)``."""
    rows = [(family, i, text) for family, texts in STATEMENTS.items() for i, text in enumerate(texts)]
    known = spark.createDataFrame(rows, "family string, statement int, text string")
    return known.select("family", "statement", grams(F.col("text")).alias("pairs"))


def _in_filter(bits: Column, pair: Column) -> Column:
    at = pair.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    return F.getbit(F.element_at(bits, (F.shiftright(at, 6) + 1).cast("int")), at.bitwiseAND(63).cast("int")) == 1


def paragraphs(docs: DataFrame, known: list[int]) -> DataFrame:
    """``(doc_id, paragraph, n_pairs, pairs)``: paragraphs with at least one known pair, and those pairs."""
    mask = [0] * (1 << FILTER_BITS - 6)
    for p in known:
        mask[(p & (1 << FILTER_BITS) - 1) >> 6] |= 1 << (p & 63)
    bits = F.lit([x - (1 << 64) if x >> 63 else x for x in mask]).cast("array<long>")
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph", "line"))
    coded = lines.select("doc_id", "paragraph", F.transform(words(F.col("line")), lambda w: F.xxhash64(w)).alias("codes"))
    some = coded.select("doc_id", "paragraph", F.size("codes").alias("n_words"), F.filter(pairs(F.col("codes")), lambda p: _in_filter(bits, p)).alias("maybe"))
    some = some.filter(F.size("maybe") > 0)
    sure = F.array_intersect("maybe", F.lit(known).cast("array<long>"))
    return some.select("doc_id", "paragraph", F.greatest(F.col("n_words") - 1, F.lit(0)).alias("n_pairs"), sure.alias("pairs")).filter(F.size("pairs") > 0)


def _examples(spark: SparkSession, known: DataFrame, found: DataFrame) -> DataFrame:
    """Labelled rows ``(label, pairs, fold)``: statements whole, without each tenth, halves and middles; corpus paragraphs as other text."""
    n = F.size("pairs")
    cuts = F.array(
        F.col("pairs"), F.slice("pairs", 1, F.greatest((n / 2).cast("int"), F.lit(1))), F.slice("pairs", (n / 2).cast("int") + 1, n),
        F.slice("pairs", (n / 4).cast("int") + 1, F.greatest((n / 2).cast("int"), F.lit(1))),
    )
    dropped = [F.filter(F.col("pairs"), _without(k)) for k in range(5)]
    mine = known.select(F.col("family").alias("label"), F.explode(F.concat(cuts, F.array(*dropped))).alias("pairs")).filter(F.size("pairs") > 0)
    known_sets = [r["pairs"] for r in known.collect()]  # the fixed statements
    shared = F.array_max(F.array(*[F.size(F.array_intersect("pairs", F.lit(p).cast("array<long>"))) for p in known_sets]))
    other = found.filter(shared < MIN_PAIRS).select("pairs", F.xxhash64("doc_id", "paragraph").alias("h")).orderBy("h").limit(OTHERS)
    blank = spark.range(200).select(F.lit(OTHER).alias("label"), F.array().cast("array<long>").alias("pairs"))
    both = mine.unionByName(other.select(F.lit(OTHER).alias("label"), "pairs")).unionByName(blank)
    return both.withColumn("fold", F.pmod(F.xxhash64("label", "pairs"), F.lit(5)))


def _without(k: int):
    return lambda p: F.pmod(F.xxhash64(p), F.lit(5)) != k


def learn(spark: SparkSession, known: DataFrame, found: DataFrame) -> tuple[list[str], list[tuple[int, list[float]]], list[float], float]:
    """Classes, the weights of each known pair by class, intercepts, and the temperature."""
    examples = written(_examples(spark, known, found), "license-examples")
    labels = [OTHER, *STATEMENTS]
    rows = examples.withColumn("label", F.array_position(F.lit(labels), F.col("label")).cast("double") - 1)
    rows = rows.withColumn("terms", F.transform("pairs", lambda p: p.cast("string")))
    # The vocabulary is that of the fixed statements.
    counter = CountVectorizer(inputCol="terms", outputCol="features", binary=True, vocabSize=1 << 14).fit(rows)
    rows = counter.transform(rows)
    fit = LogisticRegression(family="multinomial", maxIter=40, regParam=0.002).fit(rows.filter("fold != 0").select("label", "features"))
    raw = fit.transform(rows.filter("fold = 0")).select("label", vector_to_array("rawPrediction").alias("z"))
    losses = raw.agg(*[
        F.avg(F.log(F.aggregate(F.transform("z", _softened(t)), F.lit(0.0), lambda a, x: a + x)) - F.element_at("z", F.col("label").cast("int") + 1) / t).alias(f"t{i}")
        for i, t in enumerate(TEMPERATURES)
    ]).first()
    best = min((x if x is not None else float("inf"), i) for i, x in enumerate(losses))[1]
    matrix = fit.coefficientMatrix.toArray()
    order = [labels[int(i)] for i in range(matrix.shape[0])]
    weights = [(int(term), matrix[:, j].tolist()) for j, term in enumerate(counter.vocabulary)]
    return order, weights, fit.interceptVector.toArray().tolist(), TEMPERATURES[best]


def _softened(t: float):
    return lambda z: F.exp(z / t)


def scan(docs: DataFrame) -> DataFrame:
    """One row per paragraph that speaks of a licence: family (or unknown), calibrated probability, best statement, confirmed."""
    spark = docs.sparkSession
    known = written(statements(spark), "license-statements")
    vocabulary = sorted(r["p"] for r in known.select(F.explode("pairs").alias("p")).distinct().collect())  # the fixed statements' pairs
    found = written(paragraphs(docs.select("doc_id", "text"), vocabulary).distinct(), "license-paragraphs")
    classes, weights, intercepts, temperature = learn(spark, known, found)
    table = F.broadcast(spark.createDataFrame(weights, "pair long, w array<double>"))
    named = ["doc_id", "paragraph"]
    each = found.select(*named, "n_pairs", F.explode("pairs").alias("pair")).join(table, "pair", "left")
    sums = each.groupBy(*named).agg(
        F.first("n_pairs").alias("n_pairs"), F.collect_set("pair").alias("pairs"),
        *[F.coalesce(F.sum(F.col("w")[i]), F.lit(0.0)).alias(f"z{i}") for i in range(len(classes))],
    )
    z = F.array(*[(F.col(f"z{i}") + b) / temperature for i, b in enumerate(intercepts)])
    top = F.array_max("z")
    total = F.aggregate(F.transform("z", lambda x: F.exp(x - F.array_max("z"))), F.lit(0.0), lambda a, x: a + x)
    best = sums.withColumn("z", z).select(
        *named, "n_pairs", "pairs", F.element_at(F.lit(classes), F.array_position("z", top).cast("int")).alias("family"), (1 / total).alias("probability")
    )
    spoken = best.filter(F.col("family") != OTHER).join(F.broadcast(known.withColumnRenamed("pairs", "known_pairs")), "family")
    both = F.size(F.array_intersect("pairs", "known_pairs"))
    cover = both / F.greatest(F.least(F.col("n_pairs"), F.size("known_pairs")), F.lit(1))
    judged = spoken.withColumn("cover", cover).groupBy(*named).agg(
        F.first("family").alias("guess"), F.first("probability").alias("probability"),
        F.max_by("statement", F.struct("cover", -F.col("statement"))).alias("statement"), F.max("cover").alias("cover"),
    )
    sure = F.col("probability") >= SURE
    return judged.select(
        *named, F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "statement", "cover",
        (sure & (F.col("cover") >= COVER)).alias("confirmed"),
    )
