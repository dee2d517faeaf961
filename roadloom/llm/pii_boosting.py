"""Operator 10, personal data by candidate gradient boosting, in DataFrame operations only.

Base spans come from one expression and one check for each kind. They miss what stands next to other digits (a telephone number
before an address of a machine, two card numbers in a row), and what is written in another way: telephone numbers without their
plus, cards of 12 or 13 digits, e-mail addresses with spaces or with the sign in words. So generators propose, with high recall and
with overlaps, runs of neighbouring digit groups and looser forms of addresses, none of which depend on the base expressions.

Boosted trees score the proposals by format (digits, groups, check digit, parts, separators) and context (the characters beside them,
whether another group of digits leads up to them). They learn from the corpus itself, over all documents: a proposal that is a base span
is positive; one that cuts or widens a base span, belongs to a base span of another kind, or is a whole match that cannot be of its
kind, is negative; the others, which the trees are there to judge, teach nothing. What gives base spans away (the plus) is no
feature. A threshold for each kind, calibrated on a fold that the trees have not seen, picks from the proposals that touch no base
span. Proposals have few forms, so what the trees learn from is a small table of forms with counts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.llm.common import let, need, read

KINDS = ("email", "ip", "card", "phone")

# What the kinds' expressions find, leftmost and without overlaps, written so that the matcher neither recurses nor starts again
# inside a run that has failed: possessive repeats, and a look behind that allows the end of the match before.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character that a text must have before the expression is tried.
GUARDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = "[A-Za-z0-9-]++"
#: Matches inside which the generators look: addresses with spaces or words for their signs, and runs of digit groups.
WIDE = {
    "email": rf"(?i)(?:\G|(?<!{_LOCAL})){_LOCAL}++(?:\x20?@\x20?|\x20?[(\[]at[)\]]\x20?|\x20at\x20(?={_PART}\x20?[(\[]?dot\b)){_PART}(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20){_PART})++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"(?:\+|(?<![0-9+]))\(?[0-9][\x20().0-9-]{6,}[0-9]",
}
DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}
FEATURES = {"kind": 4, "digits": 20, "groups": 9, "luhn": 2, "wide_part": 2, "before": 4, "after": 4, "whole": 2, "bracket": 2, "last": 5, "lead": 2, "sign": 3}
TREES, DEPTH, RATE, PRECISION = 24, 3, 0.3, 0.99
#: Sums are taken in pieces of so many numbers.
PIECE = 64


def running(values: Column) -> Column:
    """Running sums of an array of ints. Pieces are summed first and then their totals, as adding to an array copies it."""

    def sums(x: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, zero, lambda s, v: F.struct((s.at + v).alias("at"), F.concat(s.out, F.array((s.at + v).cast("int"))).alias("out")), lambda s: s.out)

    def whole(pieces: Column) -> Column:
        inner = F.transform(pieces, sums)
        totals = lambda x: sums(F.transform(x, lambda p: F.element_at(p, -1)))
        shifted = lambda x: let(totals(x), lambda t: F.transform(x, lambda p, i: F.transform(p, lambda v: v + F.when(i > 0, F.get(t, i - 1)).otherwise(0))))
        return F.flatten(let(inner, shifted))

    pieces = F.transform(F.sequence(F.lit(1), F.size(values), F.lit(PIECE)), lambda i: F.slice(values, i, PIECE))
    return F.when(F.size(values) > 0, whole(pieces)).otherwise(F.array().cast("array<int>"))


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, s): the matches of the pattern with their places in characters, the end exclusive."""
    empty = F.array().cast("array<struct<start:int,end:int,s:string>>")

    def placed(matches: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        ends = running(F.zip_with(pieces, matches, lambda p, m: F.length(p) + F.length(m)))
        spans = F.zip_with(ends, matches, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("s")))
        return F.when(F.size(matches) > 0, spans).otherwise(empty)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def luhn(digits: Column) -> Column:
    """Whether the last digit fits the others: of the digits from the right, every second one counts twice, less nine if over nine."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.get(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), x.cast("int"))))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def passes(kind: str, s: Column) -> Column:
    """The check of a kind's match."""
    digits = F.length(_digits(s))
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return (digits >= 14) & (digits <= 19) & luhn(_digits(s))
    if kind == "phone":
        return (digits >= 10) & (digits <= 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda x: passes(kind, x.s)


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with a column for each kind: its base spans, an array of (start, end, s). docs: (..., text), text not null."""
    for kind in KINDS:
        spans = F.filter(found(F.col("text"), PATTERNS[kind]), _passing(kind))
        none = F.array().cast("array<struct<start:int,end:int,s:string>>")
        docs = docs.withColumn(kind, F.when(F.contains("text", F.lit(GUARDS[kind])), spans).otherwise(none))
    return docs


def _char_class(c: Column) -> Column:
    """0: none or white space, 1: a letter, 2: a digit or a mark that joins digits, 3: another character."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9.+-]"), 2).otherwise(3)


def proposals(kind: str) -> Column:
    """The generator of a kind: an array of structs with the place, the features, and whether it is the whole match."""
    text = F.col("text")

    def one(start: Column, end: Column, s: Column, groups: Column, last: Column, whole: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), groups.cast("int").alias("groups"), last.cast("int").alias("last"), whole.alias("is_whole"), s.alias("s"), _digits(s).alias("d"))

    def between(run: Column, groups: Column) -> Column:
        low, high = DIGITS[kind]
        n = F.size(groups)
        plus = run.s.startswith("+")

        def proposal(i: Column, g: Column, j: Column, h: Column) -> Column:
            start = g.start
            if kind == "phone":  # with its plus, or with the bracket around its first group
                opened = F.substr(run.s, g.start, F.lit(1)) == "("
                start = F.when(plus, 0).when((g.start > 0) & opened, g.start - 1).otherwise(g.start)
            return one(run.start + start, run.start + h.end, F.substr(run.s, start + 1, h.end - start), j - i + 1, F.length(h.s), (i == 0) & (j == n - 1))

        def starting(g: Column, i: Column) -> Column:
            last = F.when(i + 3 < n, F.array(i + 3)).otherwise(F.array().cast("array<int>")) if kind == "ip" else F.sequence(i, F.least(n - 1, i + 18))  # more groups have too many digits
            return F.transform(last, lambda j: proposal(i, g, j, F.get(groups, j)))

        # a plus begins a number, so nothing begins after it
        heads = F.when(plus, F.slice(groups, 1, 1)).otherwise(groups) if kind == "phone" else groups
        out = F.filter(F.flatten(F.transform(heads, starting)), lambda x: (F.length(x.d) >= low) & (F.length(x.d) <= high))
        # digits in one run without a plus are numbers of all sorts
        return F.filter(out, lambda x: (x.groups > 1) | x.s.startswith("+")) if kind == "phone" else out

    def inside(run: Column) -> Column:
        if kind == "email":
            parts = F.split(run.s, r"(?i)\.|[(\[]dot[)\]]|\x20dot\x20")
            return F.array(one(run.start, run.end, run.s, F.size(parts), F.length(F.element_at(parts, -1)), F.lit(True)))
        return let(found(run.s, "[0-9]++"), lambda groups: between(run, groups))

    wanted = F.contains(text, F.lit(GUARDS[kind])) if kind == "ip" else F.contains(text, F.lit("@")) | text.rlike(r"(?i)[(\[\x20]at[)\]\x20]") if kind == "email" else F.lit(True)
    runs = F.when(wanted, found(text, WIDE[kind]))

    def features(x: Column) -> Column:
        ahead = F.substr(text, F.greatest(x.start - 1, F.lit(1)), F.least(x.start, F.lit(2)))
        before = F.when(x.start > 0, F.substr(text, x.start, F.lit(1))).otherwise("")
        sign = F.when(F.contains(x.s, F.lit("@")), 2).when(x.s.rlike("[(\\[]"), 1).otherwise(0) if kind == "email" else F.lit(0)
        values = {
            "kind": F.lit(KINDS.index(kind)), "digits": F.least(F.length(x.d), F.lit(19)), "groups": F.least(x.groups, F.lit(8)), "luhn": (luhn(x.d) if kind != "email" else F.lit(False)).cast("int"),
            "wide_part": (~passes("ip", x.s)).cast("int") if kind == "ip" else F.lit(0), "before": _char_class(before), "after": _char_class(F.substr(text, x.end + 1, F.lit(1))),
            "whole": x.is_whole.cast("int"), "bracket": F.contains(x.s, F.lit("(")).cast("int"), "last": F.least(x["last"], F.lit(4)), "lead": F.when(x.start > 0, ahead.rlike(r"[0-9][\x20().-]?$").cast("int")).otherwise(0), "sign": sign,
        }
        return F.struct(x.start.alias("start"), x.end.alias("end"), x.s.alias("s"), *[v.cast("int").alias(k) for k, v in values.items()])

    none = F.array().cast("array<struct<start:int,end:int,s:string," + ",".join(f"{f}:int" for f in FEATURES) + ">>")
    return F.coalesce(F.transform(F.flatten(F.transform(runs, inside)), features), none)


def _touches(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda y: (y.start < x.end) & (x.start < y.end))


def _labelled(kind: str):
    """A proposal's features with its label: 1 for a base span, 0 for what touches one of any kind or cannot be of its kind, else null."""

    def label(x: Column) -> Column:
        exact = F.exists(F.col(kind), lambda y: (y.start == x.start) & (y.end == x.end))
        touches = _touches(x, F.col(KINDS[0]))
        for other in KINDS[1:]:
            touches = touches | _touches(x, F.col(other))
        return F.when(exact, 1).when(touches, 0).when((x.whole == 1) & ~passes(kind, x.s), 0)

    return lambda x: F.struct(*[x[f].alias(f) for f in FEATURES], label(x).alias("label"))


def forms(docs: DataFrame) -> list:
    """Rows (features..., label, fold, n): the labelled proposals of all documents, counted by form; at most as many rows as the
    features have combinations."""
    parts = []
    for kind in WIDE:
        parts.append(F.transform(proposals(kind), _labelled(kind)))
    fold = F.pmod(F.xxhash64("text"), F.lit(4)) == 0
    rows = docs.select(fold.alias("fold"), F.explode(F.concat(*parts)).alias("x")).select("fold", "x.*").where("label is not null")
    return rows.groupBy(*FEATURES, "label", "fold").agg(F.count("*").alias("n")).collect()


class Trees:
    """Boosted trees: nested tuples (feature, bound, below, from) with numbers as leaves, the first score, and a threshold for each kind."""

    def __init__(self, first: float, trees: list, thresholds: dict[str, float]):
        self.first, self.trees, self.thresholds = first, trees, thresholds

    def margin(self, row) -> float:
        def walk(t):
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] < t[1] else t[3]
            return t

        return self.first + sum(walk(t) for t in self.trees)

    def column(self, x: Column) -> Column:
        """The probability as one expression over a proposal's features."""

        def walk(t) -> Column:
            return F.when(x[t[0]] < t[1], walk(t[2])).otherwise(walk(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        return 1 / (1 + F.exp(-reduce(lambda a, t: a + walk(t), self.trees, F.lit(float(self.first)))))


def fit(rows: list, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, precision: float = PRECISION) -> Trees:
    """Gradient boosting with the logistic loss over the forms; Newton steps at the leaves. A kind's threshold is the lowest score at
    which its part of the fold left out has the asked precision from there on up, and 0.5 at least."""
    own, held = [r for r in rows if not r.fold], [r for r in rows if r.fold]
    positive, total = sum(r.n for r in own if r.label), sum(r.n for r in own)
    if not positive or positive == total:
        return Trees(-30.0, [], dict.fromkeys(WIDE, 0.5))
    first = math.log(positive / (total - positive))
    margin = [first] * len(own)
    grown: list = []
    cuts = [(f, b) for f, size in FEATURES.items() for b in range(1, size)]
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g = [r.n * (r.label - q) for r, q in zip(own, p, strict=True)]
        h = [r.n * q * (1 - q) for r, q in zip(own, p, strict=True)]

        def grow(at: list[int], level: int):
            sg, sh = sum(g[i] for i in at), sum(h[i] for i in at)
            best, split = 1e-6, None
            if level < depth:
                for f, b in cuts:
                    lg = lh = 0.0
                    for i in at:
                        if own[i][f] < b:
                            lg, lh = lg + g[i], lh + h[i]
                    gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg * sg / (sh + 1)
                    if gain > best:
                        best, split = gain, (f, b)
            if split is None:
                step = rate * sg / (sh + 1)
                for i in at:
                    margin[i] += step
                return step
            f, b = split
            return (f, b, grow([i for i in at if own[i][f] < b], level + 1), grow([i for i in at if own[i][f] >= b], level + 1))

        grown.append(grow(list(range(len(own))), 0))
    model = Trees(first, grown, dict.fromkeys(WIDE, 0.5))
    for kind in WIDE:
        scored = sorted(((1 / (1 + math.exp(-model.margin(r))), r.label, r.n) for r in held if r.kind == KINDS.index(kind)), reverse=True)
        good = every = 0
        for i, (s, label, n) in enumerate(scored):
            good, every = good + label * n, every + n
            if i + 1 == len(scored) or scored[i + 1][0] < s:
                if s < 0.5:
                    break
                if good < precision * every:
                    model.thresholds[kind] = max(model.thresholds[kind], math.nextafter(s, 2))
    return model


def _at_least(score: float):
    return lambda x: x.score >= score


def _as_span(kind: str, score):
    return lambda x: F.struct(x.start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), x.end.alias("end"), F.lit(kind).alias("kind"), score(x).alias("score"))


def personal_data(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: Trees | None = None) -> DataFrame:
    """Rows (id, base array<struct<kind, start, end>>, spans, texts): the base spans, and all spans with those that the trees
    add, by start and then by kind as in KINDS; `spans` have the score, 1 for base ones. Null texts count as empty: no spans.
    Places are in characters (code points). Each row counts by itself; further columns play no part."""
    d = need(docs, id_column, text_column).select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    d = base_spans(d)
    if model is None:
        model = fit(forms(d))
    base = F.array_sort(F.concat(*[F.transform(F.col(k), _as_span(k, lambda x: F.lit(1.0))) for k in KINDS]))
    scored = []
    for kind in WIDE:
        free = F.filter(proposals(kind), lambda x: ~_touches(x, F.col("base")))
        scored.append(F.filter(F.transform(free, _as_span(kind, model.column)), _at_least(model.thresholds[kind])))
    # most texts have nothing that could be a proposal
    likely = F.col("text").rlike(r"(?i)[0-9][\x20().0-9-]{5,}[0-9]|@|[(\[]at[)\]]|\x20dot\x20")
    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double>>")
    picked = F.when(likely, F.concat(*scored)).otherwise(none)
    # of proposals that overlap the best one stays: the highest score, then the longest, then the first
    better = lambda x, y: (y.score > x.score) | ((y.score == x.score) & ((y.end - y.start > x.end - x.start) | ((y.end - y.start == x.end - x.start) & ((y.start < x.start) | ((y.start == x.start) & (y.order < x.order))))))
    d = d.withColumn("base", base).withColumn("picked", picked)
    added = F.filter("picked", lambda x: ~F.exists("picked", lambda y: (y.start < x.end) & (x.start < y.end) & better(x, y)))
    return d.select(F.col("id").alias(id_column), "base", F.array_sort(F.concat("base", added)).alias("spans"), "text")


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", mark: str = "[{}]", **options) -> DataFrame:
    """Rows (id, text): the text with each span replaced by its kind; of spans that overlap the first one gives the name."""
    out = personal_data(docs, id_column, text_column, **options)
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    name = F.create_map(*[F.lit(x) for k in KINDS for x in (k, mark.format(k.upper()))])

    def add(state: Column, s: Column) -> Column:
        fresh = s.start >= state.at
        text = F.when(fresh, F.concat(state.out, F.substr("text", state.at + 1, s.start - state.at), name[s.kind])).otherwise(state.out)
        return F.struct(F.greatest(state.at, s.end).alias("at"), text.alias("out"))

    whole = F.aggregate("spans", zero, add, lambda st: F.concat(st.out, F.substr("text", st.at + 1, F.length("text"))))
    return out.select(id_column, whole.alias(text_column))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def op10_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda x: x.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
