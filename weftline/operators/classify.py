"""A classifier of transformations over features of names, types and statistics, to be injected as a scorer.

Features are expressions: hashed character trigrams of source and target names, groups of keywords that each holds,
declared types and seven numbers. A multinomial logistic regression of pyspark.ml is fitted on labelled records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, OneHotEncoder, StringIndexer, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords by what they ask for, as stems; a word counts in its own form and with d or ed.
KEYWORDS = {
    "aggregation": "sum total count avg average min max aggregate", "boolean_flag": "is has flag indicator check valid active enable disable", "bucketing": "bucket bin binn band tier range quantile",
    "case_change": "lower upper initcap capitalize lowercase uppercase", "cleaning": "clean sanitize strip stripp remove filter purge wash", "concatenation": "concat concatenate full combine merge complete join",
    "dedup": "dedup deduplicate canonical unique distinct", "encryption": "encrypt decrypt cipher secret protect secure", "formatting": "format formatt display pretty human", "hashing": "hash digest checksum fingerprint md5 sha",
    "identity": "copy copi duplicate mirror same rename alias", "imputation": "impute fill default coalesce fallback missing", "json_xml": "json xml payload config metadata array nest struct",
    "lookup": "lookup enrich dimension reference resolve mapp", "masking": "mask redact anon anonymize hidden obscure", "normalization": "normalize canonical standard standardize harmonize", "output_marker": "output result final process convert transform without after",
    "parsing": "parse extract", "punctuation": "punctuation punct symbol special character char", "ranking": "rank dense row number position sequence", "raw_marker": "raw original input source dirty unprocess include with before",
    "slug": "slug slugify slugifi seo permalink url", "splitting": "split token segment part delimit delimiter", "temporal_extract": "year month day hour minute quarter week fiscal",
    "temporal_general": "date time datetime timestamp ts period interval duration", "trimming": "trim trimm pad padd lpad rpad", "type_conversion": "cast convert text str num float bool to", "window_ops": "running cumulative moving rolling lag lead prev next window",
}
# Declared types by number; others are 0.
TYPE_NUMBERS = {"string": 1, "int": 2, "decimal": 3, "date": 4, "boolean": 5}
NUMBERS = ("mean_entropy", "max_entropy", "target_entropy", "n_sources", "has_key", "delta", "overlap")


def name_words(name: Column) -> Column:
    """Lower-case words of a name; case does not part them."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "_", " "), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(name: Column) -> Column:
    """Character trigrams of each word between two marks, repeats kept."""
    marked = F.transform(name_words(name), lambda w: F.concat(F.lit("#"), w, F.lit("#")))
    return F.flatten(F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))))


def keyword_flags(words: Column) -> Column:
    """For each group of keywords, in order of its name, whether words hold one of it."""
    groups = [F.array(*[F.lit(stem + end) for stem in stems.split(" ") for end in ("", "d", "ed")]) for _, stems in sorted(KEYWORDS.items())]
    return F.array(*[F.arrays_overlap(words, g).cast("double") for g in groups])


def features(records: DataFrame) -> DataFrame:
    """records with grams (of sources, then targets, marked apart), source_flags, target_flags, types and numbers.

    records: sources (array of structs name, type, entropy, is_pk) and target (struct name, type, entropy).
    """
    words = F.flatten(F.transform("sources", lambda s: name_words(s["name"])))
    entropy = F.transform("sources", lambda s: F.coalesce(s["entropy"], F.lit(0.0)))
    n = F.size("sources")
    total = F.aggregate(entropy, F.lit(0.0), lambda a, x: a + x)
    mean = F.when(n > 0, total / n).otherwise(0.0)
    target = F.coalesce(F.col("target.entropy"), F.lit(0.0))
    known = F.create_map(*[F.lit(x) for pair in TYPE_NUMBERS.items() for x in pair])
    kind = lambda c: F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), F.lit(0)).cast("double")
    overlap = F.size(F.array_intersect(F.array_distinct(words), name_words(F.col("target.name"))))
    numbers = [mean, F.greatest(F.lit(0.0), F.coalesce(F.array_max(entropy), F.lit(0.0))), target, n, F.exists("sources", lambda s: F.coalesce(s["is_pk"], F.lit(False))), target - mean, overlap]
    marked = lambda grams, mark: F.transform(grams, lambda g: F.concat(F.lit(mark), g))
    return records.select(
        "*", F.concat(marked(F.flatten(F.transform("sources", lambda s: trigrams(s["name"]))), "s"), marked(trigrams(F.col("target.name")), "t")).alias("grams"),
        keyword_flags(words).alias("source_flags"), keyword_flags(name_words(F.col("target.name"))).alias("target_flags"),
        F.array(kind(F.get("sources", F.lit(0))["type"]), kind(F.col("target.type"))).alias("types"), F.array(*[c.cast("double") for c in numbers]).alias("numbers"))


def fit(labelled: DataFrame, size: int = 1 << 12, regularised: float = 1e-3, rounds: int = 60) -> PipelineModel:
    """A model of the column label over features() of labelled records."""
    dense = F.concat("source_flags", "target_flags", "numbers")
    rows = features(labelled).withColumns({"dense": array_to_vector(dense), "source_type": F.col("types")[0], "target_type": F.col("types")[1]})
    stages = [
        StringIndexer(inputCol="label", outputCol="label_index"), HashingTF(inputCol="grams", outputCol="hashed", numFeatures=size), OneHotEncoder(inputCols=["source_type", "target_type"], outputCols=["source_hot", "target_hot"], handleInvalid="keep", dropLast=False),
        VectorSizeHint(inputCol="dense", size=2 * len(KEYWORDS) + len(NUMBERS)), VectorAssembler(inputCols=["hashed", "dense", "source_hot", "target_hot"], outputCol="features"), LogisticRegression(labelCol="label_index", family="multinomial", regParam=regularised, maxIter=rounds),
    ]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, records: DataFrame, top: int = 3) -> DataFrame:
    """records with ranked, their best labels as structs (place, label, probability)."""
    dense = F.concat("source_flags", "target_flags", "numbers")
    rows = features(records).withColumns({"dense": array_to_vector(dense), "source_type": F.col("types")[0], "target_type": F.col("types")[1]})
    labels = F.array(*map(F.lit, model.stages[0].labels))
    out = reduce(lambda d, s: s.transform(d), model.stages[1:], rows).withColumn("p", vector_to_array("probability"))
    each = F.array_sort(F.transform(F.arrays_zip(F.col("p").alias("p"), labels.alias("l")), lambda x: F.struct((-x["p"]).alias("less"), x["l"].alias("label"))))
    ranked = F.transform(F.slice(each, 1, top), lambda x, i: F.struct((i + 1).alias("place"), x["label"].alias("label"), (-x["less"]).alias("probability")))
    return out.select(*[F.col(f"`{c}`") for c in records.columns], ranked.alias("ranked"))


def top_accuracy(predicted: DataFrame, label: str = "label") -> DataFrame:
    """(k, accuracy): the share of records whose label is among the best k."""
    place = F.get(F.filter("ranked", lambda r: r["label"] == F.col(label)), F.lit(0))["place"]
    ks = predicted.select(place.alias("at"), F.explode(F.array(F.lit(1), F.lit(3))).alias("k"))
    return ks.groupBy("k").agg(F.avg(F.coalesce(F.col("at") <= F.col("k"), F.lit(False)).cast("double")).alias("accuracy"))
