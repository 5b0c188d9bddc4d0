"""Naive Bayes over feature maps, and the features of the comment classifiers.

Feature maps are long rows (id, fname, fval). The estimates follow the
expected-likelihood scheme: 1/2 is added to every count, an example without a
feature counts as a value of its own, and at prediction only features that
are present and known take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import text as tx
from corvina.functions.stemmer import stems
from corvina.operators.learners import checkpointed


def _flags(**flags: Column) -> Column:
    return F.array(*(F.struct(F.lit(k).alias("fname"), v.alias("fval")) for k, v in flags.items()))


def _words(tokens: Column) -> Column:
    return F.transform(F.array_distinct(tokens), lambda t: F.struct(F.concat(F.lit("w="), t).alias("fname"), F.lit(True).alias("fval")))


def features(docs: DataFrame, stop_words: list[str], id_col: str = "doc_id", text_col: str = "text", length_flag: bool = True, stemmed: bool = True, sarcasm: bool = False) -> DataFrame:
    """doc_id, fname, fval of the comment features; ``sarcasm`` gives the other set of flags."""
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), raw.alias("raw"), tx.normalize_comment(F.col(text_col)).alias("norm"))
    tokens = tx.wordpunct_tokens(F.col("norm"))
    kept = tx.without(tx.at_least(tokens, 2), stop_words)
    if not sarcasm:
        kept = F.filter(kept, lambda t: ~tx.is_number(t))
    rows = rows.select("doc_id", "raw", "norm", tokens.alias("tokens"), (stems(kept) if stemmed else kept).alias("kept"))
    exclaims = F.col("raw").contains("!")
    if sarcasm:
        flags = _flags(HAS_EXCLAMATION=exclaims, HAS_ELLIPSIS=F.col("raw").contains("..."), LONG_TEXT=F.length("norm") > 100, HYPERBOLE_START=tx.starts_hyperbolic(F.col("raw")))
    else:
        flags = _flags(HAS_EXCLAMATION=exclaims, HAS_NEGATION=tx.has_negation(F.col("norm")), **({"LEN_GT_120": F.length("norm") > 120} if length_flag else {}))
        # a number is a feature only if there is one
        flags = F.concat(flags, F.when(tx.has_number(F.col("tokens")), _flags(HAS_NUMBER=F.lit(True))).otherwise(F.array_except(_flags(HAS_NUMBER=F.lit(True)), _flags(HAS_NUMBER=F.lit(True)))))
    return rows.select("doc_id", F.explode(F.concat(flags, _words(F.col("kept")))).alias("f")).select("doc_id", "f.fname", "f.fval")


def train(feats: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(label, n_label, p) and (label, fname, fval, n, p): priors and feature probabilities. labels: doc_id, label."""
    by_label = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_label"))
    totals = by_label.agg(F.sum("n_label").alias("n_all"), F.count(F.lit(1)).alias("n_labels"))
    # labels are few: broadcast-sized by nature; a one-row total is a lookup
    priors = by_label.join(F.broadcast(totals)).select("label", "n_label", ((F.col("n_label") + 0.5) / (F.col("n_all") + 0.5 * F.col("n_labels"))).alias("p"))
    seen = feats.join(labels, "doc_id").groupBy("label", "fname", "fval").agg(F.count(F.lit(1)).alias("n"))
    # a feature has a cell for each label and value, so all of its estimates come from one row
    value = F.coalesce(F.col("fval").cast("string"), F.lit("none"))
    cells = seen.groupBy("fname").agg(F.collect_list(F.struct("label", value.alias("v"), "n")).alias("cells"))
    every = by_label.agg(F.collect_list(F.struct("label", "n_label")).alias("labels"))
    count = lambda holds: F.aggregate(F.filter("cells", holds), F.lit(0).cast("long"), lambda total, c: total + c["n"])
    missing = lambda x: x["n_label"] - count(lambda c: c["label"] == x["label"])
    rows = cells.join(F.broadcast(every)).withColumn("labels", F.transform("labels", lambda x: F.struct(x["label"].alias("label"), x["n_label"].alias("n_label"), missing(x).alias("missing"))))
    none = F.when(F.exists("labels", lambda x: x["missing"] > 0), F.array(F.lit("none"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("values", F.array_union(F.transform("cells", lambda c: c["v"]), none))
    rows = rows.withColumn("x", F.explode("labels")).withColumn("v", F.explode("values"))
    n = F.when(F.col("v") == "none", F.col("x.missing")).otherwise(F.lit(0)) + count(lambda c: (c["label"] == F.col("x.label")) & (c["v"] == F.col("v")))
    rows = rows.select(F.col("x.label").alias("label"), "fname", F.when(F.col("v") != "none", F.col("v") == "true").alias("fval"), n.cast("long").alias("n"), F.col("x.n_label").alias("n_label"), F.size("values").alias("bins"))
    return priors, rows.select("label", "fname", "fval", "n", ((F.col("n") + 0.5) / (F.col("n_label") + 0.5 * F.col("bins"))).alias("p"))


def posterior(docs: DataFrame, feats: DataFrame, model: tuple[DataFrame, DataFrame], id_col: str = "doc_id") -> DataFrame:
    """doc_id, label, p for every document and label; present, known features only."""
    priors, table = model
    # a value that training never saw has the probability of a count of zero
    of = lambda value: F.struct(F.lit(value).alias("fval"), F.log(F.coalesce(F.max(F.when(F.col("fval") == F.lit(value), F.col("p"))), F.min(F.col("p") * 0.5 / (F.col("n") + 0.5)))).alias("lp"))
    present = table.groupBy("label", "fname").agg(F.array(of(True), of(False)).alias("of")).select("label", "fname", F.explode("of").alias("of")).select("label", "fname", "of.*")
    evidence = feats.join(present, ["fname", "fval"]).groupBy("doc_id", "label").agg(F.sum("lp").alias("e"))
    every = docs.select(F.col(id_col).alias("doc_id")).join(F.broadcast(priors.select("label", F.log("p").alias("prior"))))
    logs = every.join(evidence, ["doc_id", "label"], "left").select("doc_id", "label", (F.col("prior") + F.coalesce("e", F.lit(0.0))).alias("s"))
    w = Window.partitionBy("doc_id")
    return logs.withColumn("m", F.max("s").over(w)).withColumn("x", F.exp(F.col("s") - F.col("m"))).select("doc_id", "label", (F.col("x") / F.sum("x").over(w)).alias("p"))


def predict(docs: DataFrame, feats: DataFrame, model: tuple[DataFrame, DataFrame], id_col: str = "doc_id") -> DataFrame:
    """doc_id, label, p of the most probable label; of labels that tie to 12 places, the last in order."""
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("p", 12)), F.desc("label")))
    return posterior(docs, feats, model, id_col).withColumn("r", best).where("r = 1").select("doc_id", "label", "p")


def score_table(docs: DataFrame, predicted: DataFrame, names: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """texto, prediccion, confianza: the texts with the names of their labels and the probability to two decimals."""
    label = F.col("label").cast("string")
    for key, name in (names or {}).items():
        label = F.when(F.col("label") == key, name).otherwise(label)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("texto")).join(predicted, "doc_id").select("texto", label.alias("prediccion"), F.format_string("%.2f", "p").alias("confianza"))


def train_events(counts: DataFrame, labels: DataFrame, kind: str = "multinomial", smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(label, base) and (term, label, w) of the multinomial or the Bernoulli model.

    counts: doc_id, term, tf; labels: doc_id, label. A document's score for a
    label is its base and the weights of its terms, times their counts in the
    multinomial model. Rows without a label teach nothing.
    """
    known = labels.where("label is not null").select("doc_id", "label")
    n = F.sum("tf") if kind == "multinomial" else F.count(F.lit(1))
    seen = checkpointed(counts.join(known, "doc_id").groupBy("term", "label").agg(n.alias("n")))
    size = seen.agg(F.count_distinct("term").alias("n_terms"))
    by_label = known.groupBy("label").agg(F.count(F.lit(1)).alias("n_label")).join(seen.groupBy("label").agg(F.sum("n").alias("mass")), "label", "left")
    every = by_label.agg(F.collect_list(F.struct("label", "n_label", F.coalesce("mass", F.lit(0)).alias("mass"))).alias("labels"), F.sum("n_label").alias("n_all"))
    every = every.join(F.broadcast(size))
    # one row for each term, then one for each label of it; labels are few
    cells = seen.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m")).join(F.broadcast(every)).select("term", "m", "n_terms", F.explode("labels").alias("x"))
    n = F.coalesce(F.try_element_at("m", F.col("x.label")), F.lit(0)) + smoothing
    prior = every.select(F.explode("labels").alias("x"), "n_all").select(F.col("x.label").alias("label"), F.log(F.col("x.n_label") / F.col("n_all")).alias("base"))
    if kind == "multinomial":
        return prior, cells.select("term", F.col("x.label").alias("label"), F.log(n / (F.col("x.mass") + smoothing * F.col("n_terms"))).alias("w"))
    p = n / (F.col("x.n_label") + 2 * smoothing)
    weights = cells.select("term", F.col("x.label").alias("label"), F.log(p).alias("yes"), F.log(1 - p).alias("no"))
    absent = weights.groupBy("label").agg(F.sum("no").alias("absent"))
    return prior.join(absent, "label", "left").select("label", (F.col("base") + F.coalesce("absent", F.lit(0.0))).alias("base")), weights.select("term", "label", (F.col("yes") - F.col("no")).alias("w"))


def predict_events(docs: DataFrame, counts: DataFrame, model: tuple[DataFrame, DataFrame], kind: str = "multinomial", id_col: str = "doc_id") -> DataFrame:
    """doc_id, label of the highest score; terms that training never saw don't count, ties go to the first label."""
    bases, weights = model
    times = F.col("tf") if kind == "multinomial" else F.lit(1)
    evidence = counts.join(weights, "term").groupBy("doc_id", "label").agg(F.sum(times * F.col("w")).alias("e"))
    scores = docs.select(F.col(id_col).alias("doc_id")).join(F.broadcast(bases)).join(evidence, ["doc_id", "label"], "left").select("doc_id", "label", F.round(F.col("base") + F.coalesce("e", F.lit(0.0)), 9).alias("s"))
    best = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("s"), "label"))
    return scores.withColumn("r", best).where("r = 1").select("doc_id", "label")
