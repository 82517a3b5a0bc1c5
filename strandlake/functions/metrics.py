"""Answer metrics as columns (EVL-1..3, EVL-5..7, SET-5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.similarity import multiset_overlap
from strandlake.functions.text import answer_tokens, normalize_answer

CLOSED = ("yes", "no", "noanswer")


def once(x: Column, f) -> Column:
    """f(x) where x is worked out once, however often f names it; Catalyst would copy it to each place."""
    return F.transform(F.array(x), f)[0]


def exact_match(p: Column, g: Column) -> Column:
    return (normalize_answer(p) == normalize_answer(g)).cast("double")


def harmonic(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def overlap_scores(common: Column, n_pred: Column, n_gold: Column) -> Column:
    """struct(f1, precision, recall); all 0 without a common item."""
    p, r = F.try_divide(common, n_pred), F.try_divide(common, n_gold)
    none = common == 0
    zero = F.lit(0.0)
    return F.struct(F.when(none, zero).otherwise(2 * p * r / (p + r)).alias("f1"), F.when(none, zero).otherwise(p).alias("precision"), F.when(none, zero).otherwise(r).alias("recall"))


def token_f1(p: Column, g: Column) -> Column:
    """Token precision, recall and F1; a closed answer that differs scores 0."""
    return once(F.struct(answer_tokens(p).alias("a"), answer_tokens(g).alias("b")), lambda s: token_scores(s["a"], s["b"]))


def token_scores(a: Column, b: Column) -> Column:
    """The same of normalised tokens."""
    na, nb = F.array_join(a, " "), F.array_join(b, " ")
    closed = (na.isin(*CLOSED) | nb.isin(*CLOSED)) & (na != nb)
    common = F.when(closed, F.lit(0)).otherwise(multiset_overlap(a, b)).cast("double")
    return once(common, lambda c: overlap_scores(c, F.size(a).cast("double"), F.size(b).cast("double")))


def best_answer(p: Column, golds: Column) -> Column:
    """struct(em, f1, precision, recall) of tokens p, each at its largest over an array of golds."""

    def scores(g):
        s = token_scores(p, g)
        return once(s, lambda s: F.struct((F.array_join(p, " ") == F.array_join(g, " ")).cast("double").alias("em"), *[s[n].alias(n) for n in ("f1", "precision", "recall")]))

    all_ = F.transform(golds, lambda g: once(answer_tokens(g), scores))
    return once(all_, lambda xs: F.struct(*[F.array_max(xs[n]).alias(n) for n in ("em", "f1", "precision", "recall")]))


def set_scores(tp: Column, fp: Column, fn: Column) -> Column:
    """struct(em, f1, precision, recall) from counts; em if nothing is wrong or missing (EVL-5)."""
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    return F.struct((fp + fn == 0).cast("double").alias("em"), harmonic(p, r).alias("f1"), p.alias("precision"), r.alias("recall"))


def supporting_facts(pred: Column, gold: Column, title: str | int = "title", sent: str | int = "sent") -> Column:
    """Arrays of struct(title, sent), or of arrays by place: distinct as given, then compared with lower-case titles."""
    low = lambda xs: F.transform(F.array_distinct(xs), lambda x: F.struct(F.lower(x[title]).alias("title"), x[sent].alias("sent")))

    def counts(s):
        p, g = s["p"], s["g"]
        tp = F.size(F.filter(p, lambda x: F.array_contains(g, x)))
        fn = F.size(F.filter(g, lambda x: ~F.array_contains(p, x)))
        return once(F.struct(tp.alias("tp"), F.size(p).alias("n"), fn.alias("fn")), lambda c: set_scores(c["tp"], c["n"] - c["tp"], c["fn"]))

    return once(F.struct(low(pred).alias("p"), low(gold).alias("g")), counts)


def evidence(pred: Column, golds: Column) -> Column:
    """pred: array of keys; golds: array of arrays of alias keys. Matches count per prediction (EVL-6)."""

    def counts(s):
        tp = F.size(F.filter(s["p"], lambda x: F.exists(s["g"], lambda g: F.array_contains(g, x))))
        return once(F.struct(tp.alias("tp"), F.size(s["p"]).alias("n"), F.size(s["g"]).alias("m")), lambda c: match_scores(c["tp"], c["n"], c["m"]))

    return once(F.struct(F.array_distinct(pred).alias("p"), golds.alias("g")), counts)


def match_scores(tp: Column, n: Column, m: Column) -> Column:
    """struct(em, f1, precision, recall) of tp matches among n predictions, for m golds."""
    prec = F.when(n > 0, tp / n).otherwise(F.lit(0.0))
    rec = F.when(m > 0, tp / m).otherwise(F.lit(0.0))
    return F.struct(((tp == n) & (tp == m)).cast("double").alias("em"), harmonic(prec, rec).alias("f1"), prec.alias("precision"), rec.alias("recall"))


def joint(a: Column, b: Column, c: Column) -> Column:
    """Joint metrics of three struct(em, f1, precision, recall)."""
    p, r = a["precision"] * b["precision"] * c["precision"], a["recall"] * b["recall"] * c["recall"]
    return F.struct((a["em"] * b["em"] * c["em"]).alias("em"), harmonic(p, r).alias("f1"), p.alias("precision"), r.alias("recall"))
