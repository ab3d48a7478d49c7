"""Personal data in texts by aggregated weak supervision, in DataFrame functions only.

Strict patterns give the base spans, which always count. Looser patterns propose further candidates. Labelers of different
kinds vote on each candidate: strict pattern, check rule, gazetteers, words before it, its neighbours, its shape. Votes are
1 (personal data), -1 (none) or 0 (no opinion). Expectation-maximisation over the counts of vote patterns estimates how
reliable each labeler is, without any labelled data. The posteriors then train a span classifier on features of the
spans (a naive Bayes model with soft labels), which decides on the candidates.

A model is a few hundred numbers (kinds x labelers, kinds x feature values, which are clamped), whatever the input.
"""

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.frames import column, stored

KINDS = ("email", "ip", "card", "phone")

# Base patterns. Possessive quantifiers and the look-behind change no match: they keep long runs of one class of
# characters from being tried from each of their characters, and long repetitions from using up the stack.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the strict pattern that passes.
STRICT_GATE = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9][\x20().0-9-]"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[{](?i:at)[)\]}]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[{](?i:dot)[)\]}]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.+-])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
LOOSE_GATE = {"email": r"[(\[{](?i:at)[)\]}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"[0-9]{3}[.-][0-9]{4}"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

LABELERS = ("strict", "rule", "gazetteer", "context", "neighbours", "shape")
# Gazetteers.
DOMAINS = r"(?i)(?:\.|[)\]}]\x20?)(?:com|org|net|edu|gov|info|io|dev|eu|uk|us|de|fr|es|it|nl|ch|at|be|pl|ru|cn|jp|in|br)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
CALLING = r"^\+?(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
RESERVED = r"^0*(?:0|10|127|22[4-9]|2[3-5][0-9])\.|^0*192\.0*168\.|^0*172\.0*(?:1[6-9]|2[0-9]|3[01])\."
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|adresse|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|client|adresse)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|telefon|tel[eé]fono|t[eé]l[eé]phone)\b",
}
COUNTER_CUES = r"(?i)\b(?:version|isbn|issn|doi|order|token|sha|md5|build|release|id)\b"
BEFORE = 40  # characters that the context labeler reads
THRESHOLD = 0.5
ROUNDS = 30


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the checksum?"""
    spread = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (F.pmod(i, F.lit(2)) + 1))
    return F.pmod(F.aggregate(spread, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(F.coalesce(d, F.lit(0)))), F.lit(10)) == 0


def passes(kind: str, value: Column) -> Column:
    """Does a match of the strict pattern count?"""
    if kind == "ip":
        return value.rlike(OCTETS)
    digits = F.length(_digits(value))
    if kind == "card":
        return digits.between(16, 19) & luhn(_digits(value))
    return digits.between(8, 15) if kind == "phone" else F.lit(True)


def _matches(text: Column, kind: str, pattern: str, gate: str, strict: bool) -> Column:
    """Leftmost non-overlapping matches that pass: kind, start, end (code points, end exclusive), strict."""
    values = F.regexp_extract_all(text, F.lit(pattern), 0)
    pairs = F.zip_with(values, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    span = "struct<kind:string,start:int,end:int,strict:boolean>"
    none = F.array().cast(f"array<{span}>")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        new = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.lit(strict).alias("strict")))
        ok = passes(kind, pair["value"]) if strict else luhn(_digits(pair["value"])) & pair["value"].rlike(ISSUERS) if kind == "card" else F.lit(True)
        return F.struct(end.alias("at"), F.when(ok, F.concat(state["spans"], new)).otherwise(state["spans"]).alias("spans"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])
    return F.when(text.rlike(gate), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """The base spans, by kind as listed, then start."""
    return F.concat(*[_matches(text, k, STRICT[k], STRICT_GATE[k], True) for k in KINDS])


def loose_spans(text: Column) -> Column:
    return F.concat(*[_matches(text, k, LOOSE[k], LOOSE_GATE[k], False) for k in KINDS])


def _apart(spans: Column, others: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def _in_context(text: Column, span: Column) -> Column:
    """The span with its characters and those around it, so that these are cut out of the text once."""
    low = F.greatest(span["start"] - BEFORE, F.lit(0))
    around = F.substring(text, low + 1, span["end"] + 1 - low)
    return F.struct(span.alias("span"), around.alias("around"), (span["start"] - low).alias("at"), (span["end"] - low).alias("after"))


def _judged(context: Column) -> Column:
    """The span with its votes and features."""
    span, around = context["span"], context["around"]
    kind = span["kind"]
    value = F.substring(around, context["at"] + 1, context["after"] - context["at"])
    before = F.substring(around, F.lit(1), context["at"])
    left = F.when(context["at"] > 0, F.substring(around, context["at"], F.lit(1))).otherwise("")
    right = F.substring(around, context["after"] + 1, F.lit(1))
    digits = _digits(value)

    def by_kind(email, ip, card, phone) -> Column:
        return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).otherwise(phone)

    def vote(yes: Column) -> Column:
        return F.when(yes, 1).otherwise(-1)

    cue = F.when(before.rlike(COUNTER_CUES), -1).when(by_kind(*[before.rlike(CUES[k]) for k in KINDS]), 1).otherwise(0)
    votes = F.array(
        F.when(span["strict"], 1).otherwise(0),
        by_kind(vote(F.length(value) <= 254), vote(value.rlike(OCTETS) | value.contains(":")), vote(luhn(digits)), vote(F.length(digits).between(8, 15))),
        by_kind(vote(value.rlike(DOMAINS)), F.when(value.rlike(RESERVED), -1).otherwise(0), vote(digits.rlike(ISSUERS)), F.when(value.rlike(CALLING), 1).otherwise(0)),
        cue,
        vote(~left.rlike(r"[\p{L}\p{N}]") & ~right.rlike(r"[\p{L}\p{N}]")),
        by_kind(
            F.when(value.rlike(r"^[A-Za-z0-9]"), 1).otherwise(-1),
            vote(~value.rlike(r"(?:^|\.)0[0-9]")),
            vote(value.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$")),
            vote(value.rlike(r"[\x20().-]")),
        ),
    )

    def near(c: Column) -> Column:
        return F.when(c == "", "edge").when(c.rlike(r"\s"), "blank").when(c.rlike(r"\p{L}"), "letter").when(c.rlike(r"\p{N}"), "digit").otherwise("mark")

    features = F.array(
        F.concat(F.lit("digits "), F.least(F.length(digits), F.lit(20)).cast("string")),
        F.concat(F.lit("length "), F.least((F.length(value) / 4).cast("int"), F.lit(20)).cast("string")),
        F.concat(F.lit("marks "), F.least(F.length(F.regexp_replace(value, r"[\p{L}\p{N}]", "")), F.lit(10)).cast("string")),
        F.concat(F.lit("left "), near(left)),
        F.concat(F.lit("right "), near(right)),
        F.concat(F.lit("cue "), cue.cast("string")),
    )
    return F.struct(kind.alias("kind"), span["start"].alias("start"), span["end"].alias("end"), span["strict"].alias("strict"), votes.alias("votes"), features.alias("features"))


def with_candidates(docs: DataFrame, text: str = "text", name: str = "candidates") -> DataFrame:
    """``docs`` with an array of candidates: kind, start, end, strict, votes, features. Null texts have none."""
    whole = F.coalesce(column(text).cast("string"), F.lit(""))
    found = docs.withColumn("_base", base_spans(whole)).withColumn("_loose", _apart(loose_spans(whole), F.col("_base")))
    # Of overlapping loose spans, the one of the first kind stays.
    alone = F.filter("_loose", lambda s: ~F.exists("_loose", lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (F.array_position(F.array(*map(F.lit, KINDS)), o["kind"]) < F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]))))
    in_context = F.transform(F.concat("_base", alone), lambda s: _in_context(whole, s))
    return found.withColumn(name, F.transform(in_context, _judged)).drop("_base", "_loose")


@dataclass
class Model:
    """Per kind: the share of personal data, labelers' reliabilities, log odds and weights of feature values."""

    prior: dict[str, float] = field(default_factory=dict)
    reliability: dict[str, list[float]] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)


def _log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _posterior(prior: Column, reliability: Column, votes: Column) -> Column:
    says = F.zip_with(votes, reliability, lambda v, r: v * _log_odds(r))
    return 1 / (1 + F.exp(-(_log_odds(prior) + F.aggregate(says, F.lit(0.0), lambda a, x: a + x))))


def _estimated(patterns: Column) -> Column:
    """EM over vote patterns (votes, n): prior and reliabilities. Each reliability starts from 8 votes, 80 % of them right."""
    n = len(LABELERS)
    begin = F.struct(F.lit(0.7).alias("prior"), F.array(*[F.lit(0.8)] * n).alias("reliability"))

    def total(rows: Column, value) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda a, r: a + value(r))

    def round_of(state: Column, _: Column) -> Column:
        rows = F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), _posterior(state["prior"], state["reliability"], p["votes"]).alias("p")))
        prior = (total(rows, lambda r: r["n"] * r["p"]) + 1) / (total(rows, lambda r: r["n"].cast("double")) + 2)

        def right(i: int) -> Column:
            def share(r: Column) -> Column:
                v = r["votes"][i]
                return r["n"] * F.when(v == 1, r["p"]).when(v == -1, 1 - r["p"]).otherwise(0.0)

            votes = total(rows, lambda r: r["n"] * F.abs(r["votes"][i]).cast("double"))
            return F.greatest(F.least((total(rows, share) + 6.4) / (votes + 8), F.lit(0.999)), F.lit(0.5))

        return F.struct(prior.alias("prior"), F.array(*[right(i) for i in range(n)]).alias("reliability"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, round_of)


def fit(candidates: DataFrame, name: str = "candidates") -> Model:
    """A model from a table with candidates (see ``with_candidates``), all of whose rows count.

    Kinds without candidates get no entry; their candidates are judged by even odds.
    """
    spans = candidates.select(F.explode(name).alias("c")).select("c.*")
    # At most 3 ** 6 vote patterns a kind.
    patterns = spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("patterns"))
    model = Model()
    for row in patterns.select("kind", _estimated(F.col("patterns")).alias("m")).collect():
        model.prior[row.kind], model.reliability[row.kind] = row.m.prior, list(row.m.reliability)
    if not model.prior:
        return model
    prior = F.element_at(F.create_map(*[F.lit(x) for kv in model.prior.items() for x in kv]), F.col("kind"))
    reliability = F.element_at(F.create_map(*[x for k, r in model.reliability.items() for x in (F.lit(k), F.array(*map(F.lit, r)))]), F.col("kind"))
    soft = spans.withColumn("p", _posterior(prior, reliability, F.col("votes")))
    # Features are clamped: at most 71 values a kind.
    sums = soft.select("kind", "p", F.explode(F.concat(F.array(F.lit("all")), "features")).alias("feature")).groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    table = {(r.kind, r.feature): (r.yes, r.no) for r in sums.collect()}
    for (kind, feature), (yes, no) in table.items():
        every = table[kind, "all"]
        if feature == "all":
            model.weights[f"{kind} all"] = math.log((yes + 1) / (no + 1))
        else:
            model.weights[f"{kind} {feature}"] = math.log((yes + 0.5) / (every[0] + 10)) - math.log((no + 0.5) / (every[1] + 10))
    return model


def with_spans(candidates: DataFrame, model: Model, name: str = "candidates", threshold: float = THRESHOLD) -> DataFrame:
    """The table with ``spans`` (kind, start, end, strict, probability) in place of its candidates; base spans all stay."""
    weights = F.create_map(*[x for k, w in sorted(model.weights.items()) for x in (F.lit(k), F.lit(w))]) if model.weights else F.create_map(F.lit(""), F.lit(0.0))

    def judged(c: Column) -> Column:
        keys = F.transform(F.concat(F.array(F.lit("all")), c["features"]), lambda f: F.concat(c["kind"], F.lit(" "), f))
        log_odds = F.aggregate(keys, F.lit(0.0), lambda a, k: a + F.coalesce(F.element_at(weights, k), F.lit(0.0)))
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["strict"].alias("strict"), (1 / (1 + F.exp(-log_odds))).alias("probability"))

    decided = F.filter(F.transform(name, judged), lambda s: s["strict"] | (s["probability"] >= threshold))
    order = F.array(*map(F.lit, KINDS))
    keyed = F.transform(decided, lambda s: F.struct(F.array_position(order, s["kind"]).alias("rank"), s["start"].alias("start"), s.alias("span")))
    return candidates.withColumn("spans", F.transform(F.array_sort(keyed), lambda s: s["span"])).drop(name)


def detect(docs: DataFrame, text: str = "text", carry: list[str] | None = None, threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """``docs`` with ``spans``: kind, start, end (code points, end exclusive), strict, probability; by kind, then start.

    The model is learned from all of ``docs`` unless one is given. Null and empty texts have no spans; repeated rows are
    judged each and count each; an empty table gives an empty table. Columns in ``carry`` (None: all) stay, except those
    named ``spans`` or ``candidates``, which are replaced or dropped.
    """
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ("spans", "candidates")]
    own = docs.select(*[column(c) for c in kept], column(text).alias("_text_of_row"))
    table = with_candidates(own, "_text_of_row").drop("_text_of_row")
    if model is None:
        table = stored(table)
        model = fit(table)
    return with_spans(table, model, threshold=threshold)


def redact(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in brackets, such as ``[EMAIL]``.

    Overlapping spans are replaced as one, named by the first. Null texts stay null. Other columns stay as they are.
    """
    narrow = with_candidates(docs.select(column(text).alias("_text_of_row")), "_text_of_row").drop("_text_of_row").filter(F.size("candidates") > 0)
    found = with_spans(with_candidates(docs.withColumn("_text_of_row", column(text)), "_text_of_row", "_candidates"), fit(stored(narrow)), "_candidates", threshold)
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(state: Column, s: Column) -> Column:
        cut = F.array(F.struct(state["at"].alias("after"), s["start"].alias("start"), s["kind"].alias("kind")))
        cuts = F.when(s["start"] < state["at"], state["cuts"]).otherwise(F.concat(state["cuts"], cut))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), cuts.alias("cuts"))

    whole = F.col("_text_of_row")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<after:int,start:int,kind:string>>").alias("cuts"))
    found = found.withColumn("_cuts", F.aggregate(spans, begin, step))
    parts = F.transform("_cuts.cuts", lambda c: F.concat(F.substring(whole, c["after"] + 1, c["start"] - c["after"]), F.lit("["), F.upper(c["kind"]), F.lit("]")))
    clean = F.concat(F.array_join(parts, ""), F.substring(whole, F.col("_cuts.at") + 1, F.length(whole)))
    new = F.when(F.size("spans") == 0, F.col("_text_of_row")).otherwise(clean)
    return found.select(*[new.alias(c) if c == text else column(c) for c in docs.columns])
