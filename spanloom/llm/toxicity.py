"""Toxicity: gradient-boosted trees over dense features, calibrated isotonically.

The features are densities: of a seed lexicon, of words and word beginnings learned from
labelled rows, of second-person words near a lexicon word, and rates of capitals, punctuation and
obfuscation.  Trees and calibration are Spark ML's; features are computed in Arrow
batches.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.stage import labelled_sample, staged

# Common insults, lower case.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass fool fools foolish loser losers pathetic "
    "worthless trash garbage scum scumbag filth filthy disgusting clown clowns imbecile imbeciles cretin jerk jerks "
    "bastard bastards bitch asshole crap crappy shit shitty fuck fucking fucker damn hate hateful ugly vile vermin "
    "parasite pig pigs rat retard retarded useless coward cowards liar liars creep creepy freak freaks brainless "
    "dummkopf trottel arschloch scheisse scheiße blöd blödmann depp wichser hurensohn abschaum versager "
    "connard connasse salaud salope merde imbécile crétin abruti débile ordure minable "
    "idiota imbécil estúpido estúpida mierda cabrón puta basura inútil asqueroso gilipollas tonto payaso"
).split()
# Second-person words.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine euch ihr tu toi te ton ta tes vous votre tú usted ustedes vosotros".split()
# Characters often written for letters.
LEET = str.maketrans("013457@$!*", "oieastasi ")
FEATURES = [
    "words_log",
    "seed_rate",
    "seed_hits",
    "seed_kinds",
    "word_rate",
    "word_hits",
    "word_kinds",
    "stem_rate",
    "stem_kinds",
    "second_person",
    "upper_rate",
    "punct_rate",
    "shout_rate",
    "obfuscated_hits",
]
NEAR = 8
STEM = 4
TOKEN = re.compile(r"[^\W_]+")
MASKED = re.compile(r"\b(?=\w*[^\W\d_])[\w@$!*]*[0134578@$!*][\w@$!*]*\w\b")
UPPER_DROP = bytes(set(range(256)) - set(range(65, 91)))
PUNCT_DROP = bytes(set(range(256)) - set(b".,;:?!'\"-()"))
SHOUT_DROP = bytes(set(range(256)) - set(b"?!"))


def features_of(text: str | None, words: frozenset[str], stems: frozenset[str]) -> list[float]:
    """The dense features of one whole text; null counts as empty."""

    text = text or ""
    lower = text.lower()
    tokens = TOKEN.findall(lower)
    n = max(len(tokens), 1)
    seed = [i for i, t in enumerate(tokens) if t in SEED]
    learned = [i for i, t in enumerate(tokens) if t in words]
    begin = {t[:STEM] for t in set(tokens)} & stems
    by_stem = [i for i, t in enumerate(tokens) if t[:STEM] in begin] if begin else []
    near = 0
    hits = sorted({*seed, *learned})
    if hits:
        persons = [i for i, t in enumerate(tokens) if t in PERSONS]
        at = 0
        for i in persons:
            while at + 1 < len(hits) and abs(hits[at + 1] - i) <= abs(hits[at] - i):
                at += 1
            near += abs(hits[at] - i) <= NEAR
    masked = 0
    if any(c in lower for c in "013457@$!*"):
        masked = sum(m.group().translate(LEET) in SEED for m in MASKED.finditer(lower) if m.group() not in SEED)
    raw = text.encode("utf-8", "replace")
    size = max(len(raw), 1)
    return [
        math.log1p(len(tokens)),
        len(seed) / n,
        float(min(len(seed), 50)),
        float(len({tokens[i] for i in seed})),
        len(learned) / n,
        float(min(len(learned), 50)),
        float(len({tokens[i] for i in learned})),
        len(by_stem) / n,
        float(len(begin)),
        near / n,
        len(raw.translate(None, UPPER_DROP)) / size,
        len(raw.translate(None, PUNCT_DROP)) / size,
        len(raw.translate(None, SHOUT_DROP)) / size,
        float(masked),
    ]


SEED = frozenset(INSULTS)
PERSONS = frozenset(SECOND_PERSON)


@dataclass
class ToxicityModel:
    """Learned lexicons, trees, and the steps of the calibration."""

    words: frozenset[str]
    stems: frozenset[str]
    trees: GBTClassificationModel | None
    steps: list[tuple[float, float]]
    prior: float


def with_features(docs: DataFrame, words: frozenset[str], stems: frozenset[str], keep_text: bool = False) -> DataFrame:
    """``docs`` (with ``text``) and the columns ``FEATURES`` in place of the text, or beside it."""

    kept = [c for c in docs.columns if keep_text or c != "text"]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features_of(t, words, stems) for t in batch.column("text").to_pylist()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FEATURES)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), *(pa.array(c, pa.float64()) for c in columns)], [*kept, *FEATURES]
            )

    ddl = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} double" for c in FEATURES]
    return docs.mapInArrow(compute, ", ".join(ddl))


def learn_lexicon(
    rows: DataFrame, size: int, min_texts: int, min_ratio: float
) -> tuple[frozenset[str], frozenset[str]]:
    """Words and word beginnings that mark toxic texts: at most ``size`` of each.

    Counted per distinct text, so that copies of one text do not make its words look telling.
    """

    texts = rows.groupBy("text").agg(F.max("label").alias("label"))
    words = texts.select(
        "label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")
    ).where(F.length("word") >= 3)
    found = []
    for unit, least in ((F.col("word"), 1), (F.substring("word", 1, STEM), STEM)):
        total = (
            words.where(F.length("word") >= least)
            .groupBy(unit.alias("unit"))
            .agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
            .where((F.col("bad") >= min_texts) & (F.col("bad") >= min_ratio * F.col("good")))
            .orderBy(F.desc("bad"), "unit")
            .limit(size)
        )
        found.append(frozenset(r[0] for r in total.select("unit").collect()))
    return found[0], found[1]


def train_toxicity(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, lexicon_size: int = 5_000, rounds: int = 20, depth: int = 4
) -> ToxicityModel:
    """Learn from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, label`` 0 or 1).

    The sample is bounded by ``sample_rows`` labelled identifiers.  Three quarters of it, by
    digest, learn the lexicons and the trees, the rest the calibration.  Without both classes
    the model scores the share of toxic rows.
    """

    rows = staged(labelled_sample(docs, labels, sample_rows, "toxicity"), "toxic-sample")
    half = F.pmod(F.xxhash64("draw"), F.lit(4))
    fit, hold = rows.where(half != 0), rows.where(half == 0)
    n, bad = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if n == 0 or bad in (0, n):
        return ToxicityModel(frozenset(), frozenset(), None, [], bad / n if n else 0.0)
    words, stems = learn_lexicon(fit, lexicon_size, min_texts=3, min_ratio=20.0)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    table = staged(with_features(rows.select("doc_id", "draw", "label", "text"), words, stems).coalesce(4), "toxic-features")
    vectors = assembler.transform(table.withColumn("label", F.col("label").cast("double")))
    kinds = vectors.where(half != 0).agg(F.count_distinct("label")).first()[0]
    if kinds < 2:
        return ToxicityModel(words, stems, None, [], bad / n)
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, maxBins=64, seed=7, minInstancesPerNode=5).fit(
        vectors.where(half != 0)
    )
    raw = trees.transform(vectors.where(half == 0)).select(
        "label", vector_to_array("probability")[1].alias("raw"), F.lit(1.0).alias("weight")
    )
    steps: list[tuple[float, float]] = []
    if hold.limit(1).count():
        shape = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(raw)
        steps = list(zip(shape.boundaries.toArray().tolist(), shape.predictions.toArray().tolist(), strict=True))
    return ToxicityModel(words, stems, trees, steps, bad / n)


def calibrated(raw: Column, steps: list[tuple[float, float]], blend: float = 0.02) -> Column:
    """Linear interpolation between the isotonic steps, as a native expression.

    ``blend`` of the raw score keeps the order of texts within one step.
    """

    if not steps:
        return raw
    value = F.lit(steps[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(steps, steps[1:], strict=False))):
        line = F.lit(y0) + (raw - F.lit(x0)) * F.lit((y1 - y0) / (x1 - x0) if x1 > x0 else 0.0)
        value = F.when(raw <= F.lit(x1), line).otherwise(value)
    value = F.when(raw <= F.lit(steps[0][0]), F.lit(steps[0][1])).otherwise(value)
    return F.lit(1 - blend) * value + F.lit(blend) * raw


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3, keep_text: bool = False) -> DataFrame:
    """``docs`` without the text (unless ``keep_text``), with ``score`` (0 to 1) and ``predicted`` (score >= threshold).

    Every row gets a score: null and empty texts have zero features.  Repeated rows and equal
    texts get equal scores; other columns pass through, except those named like a feature or result.
    """

    own = {*FEATURES, "features", "rawPrediction", "probability", "prediction", "score", "predicted"}
    base = docs.select(*[c for c in docs.columns if c not in own])
    if model.trees is None:
        out = (base if keep_text else base.drop("text")).withColumn("score", F.lit(float(model.prior)))
    else:
        scored = model.trees.transform(
            VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(base, model.words, model.stems, keep_text))
        )
        raw = vector_to_array("probability")[1]
        kept = [c for c in base.columns if keep_text or c != "text"]
        out = scored.select(*kept, raw.alias("raw")).select(*kept, calibrated(F.col("raw"), model.steps).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
