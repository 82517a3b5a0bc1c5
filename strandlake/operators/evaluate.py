"""Corpus metrics (AGG-4..7, EVL-4..8, JOIN-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.metrics import CLOSED, best_answer, joint, match_scores, overlap_scores, supporting_facts
from strandlake.functions.similarity import multiset_overlap
from strandlake.functions.text import after_thinking, answer_tokens, normalize_evidence
from strandlake.operators.durable import stored

METRICS = ("em", "f1", "precision", "recall")


def answer_rows(rows: DataFrame, pred: str = "pred", gold: str = "gold") -> DataFrame:
    """Adds em, f1, precision, recall. Tokens and their overlap are columns of their own, computed once."""
    d = rows.withColumns({"p__": answer_tokens(F.col(pred)), "g__": answer_tokens(F.col(gold))})
    p, g = F.col("p__"), F.col("g__")
    d = d.withColumns({"np__": F.array_join(p, " "), "ng__": F.array_join(g, " "), "c__": multiset_overlap(p, g)})
    closed = (F.col("np__").isin(*CLOSED) | F.col("ng__").isin(*CLOSED)) & (F.col("np__") != F.col("ng__"))
    common = F.when(closed, F.lit(0)).otherwise(F.col("c__")).cast("double")
    d = d.withColumns({"em": (F.col("np__") == F.col("ng__")).cast("double"), "c__": common})
    d = d.withColumn("s__", overlap_scores(F.col("c__"), F.size("p__").cast("double"), F.size("g__").cast("double")))
    return d.select("*", "s__.f1", "s__.precision", "s__.recall").drop("s__", "p__", "g__", "np__", "ng__", "c__")


def best_of_golds(rows: DataFrame, key: str) -> DataFrame:
    """Each metric at its largest over the golds of a key, one by one."""
    names = ("em", "f1", "precision", "recall")
    return answer_rows(rows).groupBy(key).agg(*[F.max(n).alias(n) for n in names])


def corpus_metrics(gold: DataFrame, scored: DataFrame, key: str, names=("em", "f1", "precision", "recall")) -> DataFrame:
    """Means x 100 over all gold rows; a gold without a prediction counts 0."""
    j = gold.select(key).join(scored, key, "left")
    return j.agg(F.count("*").alias("n"), *[F.round(100 * F.sum(F.coalesce(n, F.lit(0.0))) / F.count("*"), 6).alias(n) for n in names])


def label_set_means(rows: DataFrame) -> DataFrame:
    """Means of rows (answer, labels array<string>): the best of a row's labels, metric by metric (AGG-7).

    What precedes the last end of thinking is no answer. Rows without labels or answer count in no mean.
    """
    d = rows.withColumn("row", F.monotonically_increasing_id()).select("row", after_thinking(F.col("answer")).alias("pred"), F.explode("labels").alias("gold"))
    best = best_of_golds(d.where("pred is not null and gold is not null"), "row")
    return best.agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in ("em", "f1", "precision", "recall")])


def evaluation(gold: DataFrame, answers: DataFrame, facts: DataFrame, evidences: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row of 16 corpus metrics in per cent (EVL-8).

    ``gold`` (_id, answer, answer_id, supporting_facts, evidences, evidences_id); ``answers``, ``facts`` and
    ``evidences`` (_id, pred): predictions, any of which may miss rows; ``aliases`` (Q_id, names). A missing
    prediction counts 0 in its part and in the joint metrics; means are over all gold rows. Evidence ids
    that do not fit their evidences are an error.
    """
    said = lambda d, name: d.select("_id", F.col("pred").alias(name))
    rows = gold.join(said(answers, "answer_pred"), "_id", "left").join(said(facts, "sp_pred"), "_id", "left").join(said(evidences, "evi_pred"), "_id", "left")
    return evaluate_rows(rows, aliases)


def evaluate_rows(d: DataFrame, aliases: DataFrame) -> DataFrame:
    """The same of golds that have their predictions beside them: answer_pred, sp_pred and evi_pred, null if missing.

    A gold stays one row until it is cut into triples, once, and these meet where their gold was: rows dealt by _id
    are not dealt again unless names are too many to broadcast.
    """
    key = lambda x: F.coalesce(normalize_evidence(x), F.lit("\x01"))
    d = d.withColumn("row", F.monotonically_increasing_id())
    # Names are looked up in a table of known size: broadcast if small, so few hot ids do not gather all triples.
    names = aliases.groupBy("Q_id").agg(F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    names = stored(names.withColumn("keys", F.transform("names", key)), "names")
    other = lambda d, id_, c, out: d.join(names.select(F.col("Q_id").alias(id_), F.col(c).alias(out)), id_, "left")

    d = other(d, "answer_id", "names", "more").withColumn("p", answer_tokens(F.col("answer_pred")))
    alike = F.array_union(F.array("answer"), F.coalesce("more", F.array().cast("array<string>")))
    d = d.withColumns({"one": best_answer(F.col("p"), alike), "two": supporting_facts(F.col("sp_pred"), F.col("supporting_facts"), 0, 1)})

    ids = F.coalesce("evidences_id", F.array().cast("array<array<string>>"))
    fits = lambda ok, c: F.when(ok, F.col(c)).otherwise(F.raise_error(F.lit("evidence ids do not fit their evidences")))
    checked = fits((F.size(ids) == 0) | (F.size(ids) == F.size("evidences")), "evidences")
    distinct = F.array_distinct(F.transform("evi_pred", lambda t: F.struct(key(t[0]).alias("s"), key(t[1]).alias("r"), key(t[2]).alias("o"))))
    found = F.transform(distinct, lambda t, k: F.struct(t["s"].alias("s"), t["r"].alias("r"), t["o"].alias("o"), k.alias("k")))
    scores = [F.col(part)[m].alias(f"{part}_{m}") for part in ("one", "two") for m in METRICS]
    d = d.select("_id", "row", *scores, checked.alias("evidences"), ids.alias("ids"), found.alias("found"))
    kept = [f"{part}_{m}" for part in ("one", "two") for m in METRICS] + ["n", "m"]
    d = d.withColumns({"n": F.array_size("found"), "m": F.coalesce(F.array_size("evidences"), F.lit(0))})
    d = d.select("_id", "row", *kept, "ids", "found", F.posexplode_outer("evidences").alias("pos", "t")).withColumn("i", F.get("ids", F.col("pos")))
    d = d.withColumn("t", fits((F.size("ids") == 0) | (F.col("i")[1] == F.col("t")[1]), "t"))
    d = d.select("_id", "row", *kept, "found", *[F.when(F.col("pos").isNotNull(), key(F.col("t")[i])).alias(c) for i, c in enumerate("sro")], F.col("i")[0].alias("s_id"), F.col("i")[2].alias("o_id"))
    d = other(other(d, "s_id", "keys", "s_more"), "o_id", "keys", "o_more")
    named = lambda x, c: (x[c] == F.col(c)) | F.array_contains(f"{c}_more", x[c])
    hits = F.transform(F.filter("found", lambda x: (x["r"] == F.col("r")) & named(x, "s") & named(x, "o")), lambda x: x["k"])
    d = d.select("_id", "row", *kept, F.explode_outer(hits).alias("hit"))
    # A prediction counts once, however many triples it fits.
    d = d.groupBy("_id", "row").agg(F.countDistinct("hit").alias("tp"), *[F.first(c).alias(c) for c in kept])

    whole = lambda part: F.struct(*[F.col(f"{part}_{m}").alias(m) for m in METRICS])
    j = d.select(whole("one").alias("answer"), whole("two").alias("sp"), F.when(F.col("n").isNotNull(), match_scores(F.col("tp"), F.col("n"), F.col("m"))).alias("evi"))
    j = j.withColumn("joint", joint(F.col("answer"), F.col("sp"), F.col("evi")))
    mean = lambda part, m: F.round(100 * F.sum(F.coalesce(F.col(part)[m], F.lit(0.0))) / F.count("*"), 2)
    short = {"em": "em", "f1": "f1", "precision": "prec", "recall": "recall"}
    parts = {"answer": "", "sp": "sp_", "evi": "evi_", "joint": "joint_"}
    return j.agg(*[mean(p, m).alias(f"{prefix}{s}") for p, prefix in parts.items() for m, s in short.items()])
