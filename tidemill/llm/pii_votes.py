"""Personal data in texts, found by labelers that vote.

1. Candidates: spans of each kind's pattern, with the text before and after.
2. Votes: a form rule, a gazetteer, the words before, the characters around and the digits
   each say yes, no or nothing about a candidate.
3. How reliable each labeler is, kind by kind, is estimated by expectation maximisation from
   the votes alone, over all candidates. Candidates with equal votes are counted first, so
   an iteration handles a bounded number of vote patterns.
4. The posteriors train the final span classifier, a naive Bayes model on votes, length and
   surroundings: a few hundred coefficients. It accepts candidates of the kinds that no
   fixed rule accepts.

Spans of the base kinds (email, ip, card, phone) whose form rule holds always stay; others
stay if the classifier accepts them and they overlap none before them in the list of kinds.

DataFrame operations only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.stages import staged

BASE = ("email", "ip", "card", "phone")
# For each kind, what any text with a span must match, and the pattern. Runs
# are possessive and begin at their first character, so that long ones take linear time.
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9]", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "national_phone": (r"[0-9][ .-][0-9]", r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "social_security": (r"-[0-9]{2}-", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": (r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "spelled_email": (r"[\[(]at[\])]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++"),
    "secret": (r"(?i)key|token|secret|passw|pwd", r"(?<=(?i:key|token|secret|password|passwd|pwd)[\x22']?[ ]?[:=][ ]?[\x22']?)[A-Za-z0-9+/_~-]{12,}+"),
}
KINDS = tuple(PATTERNS)
# Gazetteers and context words.
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|me|tv|eu|uk|de|fr|es|it|nl|be|ch|at|se|no|dk|fi|pl|pt|ru|cz|ie|us|ca|mx|br|ar|cl|au|nz|jp|cn|kr|in|sg|za"
COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM|TR"
CALLING = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-368]|2[2-6][0-9]|3[578][0-9]|42[013]|59[0-9]|67[0-9]|85[0-9]|88[06]|9[679][0-9]"
YES_WORDS = {
    "email": r"e?-?mail|contact|write|reach|kontakt|correo|courriel",
    "ip": r"\bip\b|host|server|address|client|from",
    "card": r"card|visa|mastercard|amex|credit|payment|karte|carte|tarjeta",
    "phone": r"phone|tel|call|fax|mobile|cell|telefon|t[ée]l[ée]phone|tel[ée]fono",
    "national_phone": r"phone|tel|call|fax|mobile|cell|telefon|t[ée]l[ée]phone|tel[ée]fono",
    "social_security": r"ssn|social security|tax|taxpayer",
    "iban": r"iban|account|bank|konto|compte|cuenta",
    "spelled_email": r"e?-?mail|contact|write|reach",
    "secret": r"key|token|secret|passw|pwd|auth|credential",
}
NO_WORDS = r"version|order|invoice|isbn|issn|\bref\b|serial|model|example|section|page|figure|chapter"
PLACEHOLDER = r"(?i)x{4}|\*{4}|example|changeme|your|placeholder|dummy|1234567890"
LABELERS = ("form", "gazetteer", "context", "edges", "digits")
YES, NO, NOTHING = 1, 0, 2
ROUNDS = 25
#: Beliefs before any vote: a labeler that votes is right eight times out of ten.
RIGHT, WRONG = 8.0, 2.0
CONTEXT = 48
#: Matches whose positions are summed up one by one.
BLOCK = 128


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    """Every part of a dotted number is at most 255."""

    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return (F.length(bare) <= 3) & (F.when(F.length(bare) <= 3, bare).otherwise("999").cast("int") <= 255)

    return F.forall(F.split(value, r"\."), small)


def _form(kind: str, value: Column) -> Column:
    digits = _digits(value)
    rules = {
        "email": F.lit(True),
        "ip": _octets(value),
        "card": luhn(digits),
        "phone": F.length(digits).between(8, 15),
        "national_phone": digits.rlike("^[2-9]"),
        "social_security": ~value.rlike("^(?:000|666|9)|-00-|-0000$"),
        "iban": F.length(F.regexp_replace(value, " ", "")).between(15, 34),
        "spelled_email": value.rlike(r"[A-Za-z]$"),
        "secret": value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 16),
    }
    return rules[kind]


def _gazetteer(kind: str, value: Column) -> Column:
    yes = {
        "email": value.rlike(rf"(?i)\.(?:{TOP_LEVEL})$"),
        "ip": ~value.rlike(r"^0*(?:0|10|127|22[4-9]|2[3-5][0-9]|169\.0*254|192\.0*168)\."),
        "card": value.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"),
        "phone": value.rlike(rf"^\+(?:{CALLING})(?![0-9]{{12}})"),
        "national_phone": ~_digits(value).rlike("^(?:555|800|900)"),
        "social_security": ~value.rlike("^(?:123-45-6789|219-09-9999|078-05-1120)$"),
        "iban": value.rlike(rf"^(?:{COUNTRIES})"),
        "spelled_email": value.rlike(rf"(?i)[.\])] ?(?:{TOP_LEVEL})$"),
        "secret": ~value.rlike(PLACEHOLDER),
    }
    return yes[kind]


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, YES).when(no, NO).otherwise(NOTHING)


def _features(kind: str, hit: Column) -> Column:
    """The votes, then the length in steps and the characters on either side."""
    value, before, after = hit["value"], F.lower(hit["before"]), hit["after"]
    form, listed = _form(kind, value), _gazetteer(kind, value)
    joined = before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]")
    digits = _digits(value)
    varied = F.size(F.array_distinct(F.split(digits, "")))
    votes = [
        _vote(form, ~form),
        _vote(listed, ~listed),
        _vote(before.rlike(YES_WORDS[kind]), before.rlike(NO_WORDS)),
        _vote(~joined & (before.rlike(r"\s$") | (before == "")), joined),
        _vote((F.length(digits) >= 6) & (varied >= 4), (F.length(digits) >= 6) & (varied < 3)),
    ]
    side = [
        F.when(x == "", 0).when(x.rlike(space), 1).when(x.rlike(letter), 2).otherwise(3)
        for x, space, letter in ((before, r"\s$", r"[\p{L}\p{N}]$"), (after, r"^\s", r"^[\p{L}\p{N}]"))
    ]
    return F.array(*votes, F.least(F.floor(F.length(value) / 8), F.lit(6)).cast("int"), *side)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once: it is the only element of an array."""
    return F.transform(F.array(value), use)[0]


def hits(text: Column, needs: str, pattern: str) -> Column:
    """``start, end, value, before, after`` of every match, in code points. What the matches
    leave and the matches themselves, in turn, make up the text. Positions are summed up
    within blocks of matches, then over the blocks: no array grows match by match beyond one."""
    nothing = "cast(array() as array<struct<start:int,end:int,value:string,before:string,after:string>>)"

    def step(state: Column, r: Column) -> Column:
        start = state["at"] + F.length(r["g"])
        end = start + F.length(r["v"])
        hit = F.struct(
            start.alias("start"), end.alias("end"), r["v"].alias("value"),
            F.right(r["g"], F.lit(CONTEXT)).alias("before"), F.left(r["h"], F.lit(8)).alias("after"),
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(hit)).alias("out"))

    def placed(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        lengths = F.transform(blocks, lambda b: b["at"])
        before = F.aggregate(
            lengths, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"]
        )

        def moved(block: Column, by: Column) -> Column:
            return F.transform(
                block["out"],
                lambda h: F.struct((h["start"] + by).alias("start"), (h["end"] + by).alias("end"), h["value"].alias("value"), h["before"].alias("before"), h["after"].alias("after")),
            )

        return F.flatten(F.zip_with(blocks, before, moved))

    def blocked(rows: Column) -> Column:
        first = F.sequence(F.lit(1), F.size(rows), F.lit(BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.expr(nothing).alias("out"))
        return _bound(F.transform(first, lambda i: F.aggregate(F.slice(rows, i, F.lit(BLOCK)), start, step)), placed)

    def paired(gaps: Column) -> Column:
        found, n = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.greatest(F.size(gaps) - 1, F.lit(0))
        rows = F.zip_with(found, F.slice(gaps, 1, n), lambda v, g: F.struct(v.alias("v"), g.alias("g")))
        rows = F.zip_with(rows, F.slice(gaps, 2, n), lambda r, g: F.struct(r["v"].alias("v"), r["g"].alias("g"), g.alias("h")))
        return _bound(rows, lambda rows: F.when(F.size(rows) > 0, blocked(rows)).otherwise(F.expr(nothing)))

    return F.when(text.rlike(needs), _bound(F.split(text, pattern, -1), paired)).otherwise(F.expr(nothing))


def candidates(text: Column) -> Column:
    """All candidates of a text: ``kind, start, end, base, features``. Of base kinds only
    those whose form rule holds are candidates."""
    text = F.coalesce(text, F.lit(""))

    def of(kind: str, needs: str, pattern: str) -> Column:
        found = hits(text, needs, pattern)
        if kind in BASE:
            found = F.filter(found, lambda h: _form(kind, h["value"]))
        return F.transform(
            found,
            lambda h: F.struct(
                F.lit(kind).alias("kind"), h["start"].alias("start"), h["end"].alias("end"),
                F.lit(kind in BASE).alias("base"), _features(kind, h).alias("features"),
            ),
        )

    return F.concat(*(of(kind, *rule) for kind, rule in PATTERNS.items()))


def reliabilities(patterns: DataFrame) -> DataFrame:
    """``kind, prior, hit, reject`` from ``kind, votes, n``: for each labeler the chance of
    a yes for personal data (hit) and of a no for anything else (reject), by expectation
    maximisation over the vote patterns of a kind. NOTHING says nothing."""
    log_true = "aggregate(sequence(1, size(x.votes)), ln(s.prior), (t, j) -> t + case x.votes[j-1] when 1 then ln(s.hit[j-1]) when 0 then ln(1 - s.hit[j-1]) else 0D end)"
    log_false = "aggregate(sequence(1, size(x.votes)), ln(1 - s.prior), (t, j) -> t + case x.votes[j-1] when 1 then ln(1 - s.reject[j-1]) when 0 then ln(s.reject[j-1]) else 0D end)"
    weighed = f"transform(rows, x -> named_struct('votes', x.votes, 'n', x.n, 'p', 1 / (1 + exp({log_false} - {log_true}))))"
    share = "(aggregate(w, {right}D, (t, x) -> t + if(x.votes[j-1] = {vote}, x.n * {mass}, 0D)) / aggregate(w, {both}D, (t, x) -> t + if(x.votes[j-1] <> 2, x.n * {mass}, 0D)))"
    size = len(LABELERS)
    both = RIGHT + WRONG
    maximised = (
        "named_struct('prior', (aggregate(w, 1D, (t, x) -> t + x.n * x.p) / aggregate(w, 2D, (t, x) -> t + x.n)), "
        f"'hit', transform(sequence(1, {size}), j -> {share.format(right=RIGHT, both=both, vote=YES, mass='x.p')}), "
        f"'reject', transform(sequence(1, {size}), j -> {share.format(right=RIGHT, both=both, vote=NO, mass='(1 - x.p)')}))"
    )
    sure = RIGHT / both
    start = f"named_struct('prior', 0.5D, 'hit', array_repeat({sure}D, {size}), 'reject', array_repeat({sure}D, {size}))"
    # a let-binding: the weighed rows are the only element of an array
    step = f"transform(array({weighed}), w -> {maximised})[0]"
    rows = patterns.groupBy("kind").agg(F.collect_list(F.struct("votes", "n")).alias("rows"))
    return rows.select("kind", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step})").alias("model")).select("kind", "model.*")


def train(found: DataFrame) -> dict[tuple[str, int, int], float]:
    """The classifier's coefficients, by kind, feature (-1: the prior) and value, from all
    candidates (column ``candidate``, as :func:`candidates` makes them)."""
    votes = F.slice("features", 1, len(LABELERS))
    patterns = staged(
        found.select("candidate.*").groupBy("kind", "features").agg(F.count("*").cast("double").alias("n")), "pii-patterns"
    )
    model = reliabilities(patterns.groupBy("kind", votes.alias("votes")).agg(F.sum("n").alias("n")))
    odds = F.ln("prior") - F.ln(1 - F.col("prior"))
    for j in range(len(LABELERS)):
        yes = F.ln(F.col("hit")[j]) - F.ln(1 - F.col("reject")[j])
        no = F.ln(1 - F.col("hit")[j]) - F.ln(F.col("reject")[j])
        odds = odds + F.when(votes[j] == YES, yes).when(votes[j] == NO, no).otherwise(0.0)
    judged = patterns.join(F.broadcast(model), "kind").withColumn("p", 1 / (1 + F.exp(-odds)))
    every = F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("col"))
    rows = judged.withColumn(
        "f", F.explode(F.concat(F.array(every), F.expr("transform(features, (v, i) -> named_struct('pos', i, 'col', v))")))
    )
    sums = rows.groupBy("kind", "f.pos", "f.col").agg(F.sum(F.col("n") * F.col("p")).alias("true"), F.sum(F.col("n") * (1 - F.col("p"))).alias("false"))
    counted = {(r.kind, r.pos, r.col): (r.true, r.false) for r in sums.collect()}  # bounded by kinds and values
    weights = {}
    for (kind, feature, value), (true, false) in counted.items():
        if feature < 0:
            weights[kind, feature, value] = math.log((true + 1) / (false + 1))
        else:
            all_true, all_false = counted[kind, -1, 0]
            weights[kind, feature, value] = math.log((true + 1) / (all_true + 4)) - math.log((false + 1) / (all_false + 4))
    return weights


def accepted(found: Column, weights: dict[tuple[str, int, int], float]) -> Column:
    """``kind, start, end, score`` of the spans that stay, by kind and start."""
    pairs = [F.lit(x) for (k, f, v), w in sorted(weights.items()) for x in (f"{k}:{f}:{v}", float(w))]
    table = F.create_map(*pairs) if pairs else F.create_map(F.lit(""), F.lit(0.0))

    def weight(kind: Column, feature: Column, value: Column) -> Column:
        return F.coalesce(F.try_element_at(table, F.concat_ws(":", kind, feature.cast("string"), value.cast("string"))), F.lit(0.0))

    def scored(c: Column) -> Column:
        terms = F.transform(c["features"], lambda v, i: weight(c["kind"], i, v))
        score = F.aggregate(terms, weight(c["kind"], F.lit(-1), F.lit(0)), lambda a, b: a + b)
        return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"), score.alias("score"))

    kept = F.filter(F.transform(found, scored), lambda c: c["base"] | (c["score"] > 0))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,base:boolean,score:double>>)")

    def clear(kept: Column) -> Column:
        # base spans may overlap one another; they all stay, and come first
        base = F.filter(kept, lambda c: c["base"])

        def clash(c: Column, spans: Column) -> Column:
            return F.exists(spans, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]))

        def add(out: Column, c: Column) -> Column:
            return F.when(clash(c, out), out).otherwise(F.concat(out, F.array(c)))

        def free(base: Column) -> Column:
            return F.concat(base, F.aggregate(F.filter(kept, lambda c: ~c["base"] & ~clash(c, base)), none, add))

        return F.when(F.size(base) == F.size(kept), kept).otherwise(_bound(base, free))

    return _bound(kept, clear)


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span, or run of overlapping spans, replaced by its first kind."""
    inner = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        kept = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        out = F.when(fresh, F.concat(state["out"], kept, F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(inner, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def pii_spans(docs: DataFrame, text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``spans``: an array of ``kind, start, end, base, score``, in code points,
    end exclusive, by kind in the order of ``KINDS`` and then by start. Without ``keep_text``
    the text is left out, and read once instead of twice.

    A NULL text has no spans. Repeated rows get equal spans, an empty table gives an empty
    result, a column named ``spans`` is replaced.
    """
    others = [c for c in docs.columns if c not in ("spans", "_pii") and (keep_text or c != text_column)]
    marked = docs.select(*(f"`{c}`" for c in others), candidates(F.col(f"`{text_column}`")).alias("_pii"))
    if not keep_text:
        marked = staged(marked, "pii-candidates")
    weights = train(marked.select(F.explode("_pii").alias("candidate")))
    return marked.withColumn("spans", accepted(F.col("_pii"), weights)).drop("_pii")
