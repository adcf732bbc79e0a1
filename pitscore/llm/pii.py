"""Personal data by weak supervision, with DataFrame expressions only.

Patterns give candidate spans: the plain kinds, matches of theirs that fail their check, and looser forms.
Labelers vote on each: the exact pattern, its usual shape, a gazetteer, the words before it, its borders.
Rows with the same votes are counted; expectation-maximisation over these few counts estimates how far each
labeler can be relied on for each kind, and the resulting probabilities train a logistic span classifier.
Spans of the exact patterns always stay; the classifier adds others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.sources.io import materialize

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the kinds. Repetitions that nothing can follow are possessive, and an
#: e-mail starts where its run of characters does, so that long runs take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: At most 255, after any zeros; a part of zeros only has no more. A part's digits are tried one way only.
BYTE = "(?=[0-9])0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
#: Looser forms: spelled-out e-mail addresses, telephone numbers without a country.
LOOSE_EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++"
    r"(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++"
)
LOOSE_PHONE = r"(?<![0-9+] ?)\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
#: Gazetteers: top-level domains, card prefixes, country codes.
DOMAINS = "com|org|net|edu|gov|int|info|biz|io|eu|de|fr|es|it|nl|pl|uk|us|ca|mx|br|ar|ch|at|be|pt|se|jp|cn|in|au"
CARD_PREFIX = "^(4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|35|6011|64[4-9]|65)"
COUNTRIES = "^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|35[0-9]|37[0-9]|38[0-9]|42[01])"
#: Words just before a span that speak for a kind, and words that speak for something else.
CONTEXT = (
    "mail|contact|correo|courriel|schreib",
    "ip|host|server|address|adresse|direcci",
    "card|visa|carte|tarjeta|karte|credit|kredit",
    "phone|tel|call|fax|mobil|handy|appel|llam",
)
OTHER = "token|secret|hash|password|isbn|version|order|invoice"
ITERATIONS = 12
VOTES = ("exact", "shape", "gazetteer", "context", "border")
CHUNK = 256


def _running(sizes: Column) -> Column:
    """Sums before each element of an array, in chunks so that long arrays stay near linear."""
    zero = F.lit(0).cast("bigint")
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")),
        lambda c: F.slice(sizes, c * CHUNK + 1, CHUNK),
    )
    within = F.transform(chunks, lambda c: F.aggregate(c, F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    bases = F.aggregate(
        within, F.array(zero), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(w, -1)))
    )
    moved = F.zip_with(
        within, F.slice(bases, 1, F.size(within)), lambda w, b: F.transform(F.slice(w, 1, F.size(w) - 1), lambda v: v + b)
    )
    return F.flatten(moved)


def _spans(pieces: Column, found: Column, before: Column) -> Column:
    """Matches with their places: ``pieces`` is the text cut at the matches ``found``, ``before`` the
    length of what precedes each piece."""
    n = F.size(found)
    rows = F.arrays_zip(
        before.alias("before"), F.slice(pieces, 1, n).alias("piece"), found.alias("match"), F.slice(pieces, 2, n).alias("next")
    )

    def span(r):
        start = r["before"] + F.length(r["piece"])
        return F.struct(
            start.alias("start"), (start + F.length(r["match"])).alias("end"), r["match"].alias("value"),
            F.lower(F.right(r["piece"], F.lit(40))).alias("before"), F.left(r["next"], F.lit(1)).alias("after"),
        )

    return F.transform(rows, span)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def term(i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    places = F.sequence(F.lit(0), n - 1)
    return F.aggregate(F.transform(places, term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _exact(kind: int, value: Column) -> Column:
    d = _digits(value)
    return (
        F.lit(True),
        F.rlike(value, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$")),
        F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False),
        F.length(d).between(9, 15),
    )[kind]


def _shape(kind: int, value: Column) -> Column:
    return F.rlike(value, F.lit((
        r"^[^@\s]{1,64}( ?[(\[]at[)\]] ?|@).*[A-Za-z]{2,}$",
        r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$",
        r"^([0-9]{13,16}|[0-9]{4}([ -][0-9]{4}){3}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})$",
        r"^(\+[0-9]{1,3}[ .-]?)?(\([0-9]{2,4}\)|[0-9]{2,4})([ .-]?[0-9]{2,4}){2,4}$",
    )[kind]))


def _known(kind: int, value: Column) -> Column:
    return (
        F.rlike(F.lower(value), F.lit(rf"\b({DOMAINS})$")),
        ~F.rlike(value, F.lit(r"^(0|127|22[4-9]|2[3-9][0-9])\.")),
        F.rlike(_digits(value), F.lit(CARD_PREFIX)),
        F.rlike(_digits(value), F.lit(COUNTRIES)) & F.startswith(value, F.lit("+")),
    )[kind]


def _votes(spans: Column, kind: int, exact) -> Column:
    """Candidates with the labelers' votes: 1 for, 0 against, -1 for no opinion."""

    def vote(s):
        speaks = F.when(F.rlike(s["before"], F.lit(rf"({OTHER})\W*$")), 0).when(
            F.rlike(s["before"], F.lit(rf"({CONTEXT[kind]})\w*\W*$")), 1
        )
        joined = F.rlike(s["before"], F.lit(r"\w$")) | F.rlike(s["after"], F.lit(r"^\w"))
        is_exact = exact(s["value"])
        votes = [is_exact.cast("int"), _shape(kind, s["value"]).cast("int"), _known(kind, s["value"]).cast("int")]
        votes += [F.coalesce(speaks, F.lit(-1)), (~joined).cast("int")]
        named = [F.coalesce(v, F.lit(0)).alias(n) for n, v in zip(VOTES, votes, strict=True)]
        return F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), is_exact.alias("base"), *named)

    return F.transform(spans, vote)


def candidates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``doc_id`` (and the columns ``keep``) with ``found``, the candidate spans of the text with votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    searches = [
        (0, EMAIL, F.contains(text, F.lit("@")), lambda v: _exact(0, v)),
        (1, IP, F.rlike(text, F.lit(r"[0-9]\.[0-9]")), lambda v: _exact(1, v)),
        (2, CARD, F.rlike(text, F.lit("[0-9][ -]?[0-9]")), lambda v: _exact(2, v)),
        (3, PHONE, F.contains(text, F.lit("+")), lambda v: _exact(3, v)),
        (0, LOOSE_EMAIL, F.rlike(text, F.lit(r"[(\[]at[)\]]")), lambda v: F.lit(False)),
        (3, LOOSE_PHONE, F.rlike(text, F.lit("[0-9]{3}[ .-][0-9]{4}")), lambda v: F.lit(False)),
    ]
    kept = [F.col(c) for c in (keep or ["doc_id"])]
    rows = docs.select(*kept, *[
        F.when(asked, F.regexp_extract_all(text, F.lit(p), F.lit(0))).alias(f"_found{k}")
        for k, (_, p, asked, _) in enumerate(searches)
    ], text.alias("_text"))
    every = range(len(searches))
    rows = rows.select(*kept, *[f"_found{k}" for k in every], *[
        F.when(F.size(f"_found{k}") > 0, F.split("_text", searches[k][1], -1)).alias(f"_pieces{k}") for k in every
    ])
    rows = rows.withColumns({
        f"_sizes{k}": F.zip_with(
            F.slice(f"_pieces{k}", 1, F.size(f"_found{k}")), f"_found{k}",
            lambda p, m: (F.length(p) + F.length(m)).cast("bigint"),
        )
        for k in every
    })
    rows = rows.withColumns({f"_before{k}": F.when(F.size(f"_sizes{k}") > 0, _running(F.col(f"_sizes{k}"))) for k in every})
    none = F.array().cast(SPAN_TYPE)
    parts = []
    for k, (kind, _, _, exact) in enumerate(searches):
        spans = _spans(F.col(f"_pieces{k}"), F.col(f"_found{k}"), F.col(f"_before{k}"))
        parts.append(F.coalesce(F.when(F.col(f"_pieces{k}").isNotNull(), _votes(spans, kind, exact)), none))
    return rows.select(*kept, F.concat(*parts).alias("found"))


SPAN_TYPE = "array<struct<start:bigint,kind:int,end:bigint,base:boolean," + ",".join(f"{v}:int" for v in VOTES) + ">>"


def vote_counts(found: DataFrame) -> DataFrame:
    """How often each combination of kind and votes occurs: a few hundred rows at most."""
    rows = found.select(F.explode("found").alias("s")).select("s.*")
    return rows.groupBy("kind", *VOTES).agg(F.count("*").alias("n"))


def estimate(counts: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """The vote counts with ``p``, the probability that such a span is personal data.

    Expectation-maximisation of a naive Bayes model per kind: a prior, and for each labeler how often it
    votes for and against spans of either class. It starts from the share of votes for; counts are smoothed
    by one, so no labeler is trusted without limit.
    """
    cast = [F.when(F.col(v) >= 0, F.col(v).cast("double")) for v in VOTES]
    given = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in cast])
    for_it = reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cast])
    p = F.greatest(F.lit(0.02), F.least(F.lit(0.98), for_it / F.greatest(given, F.lit(1.0))))
    votes = F.array(F.struct(F.lit("").alias("labeler"), F.lit(0).alias("vote")), *[
        F.struct(F.lit(v).alias("labeler"), F.col(v).alias("vote")) for v in VOTES
    ])
    for _ in range(iterations):
        rows = counts.withColumn("p", p).select("kind", "n", "p", F.inline(votes)).where("vote >= 0")
        sums = rows.groupBy("kind", "labeler", "vote").agg(F.sum(F.col("n") * F.col("p")), F.sum(F.col("n") * (1 - F.col("p"))))
        n = {tuple(r)[:3]: tuple(r)[3:] for r in sums.collect()}  # a row per kind, labeler and vote
        p = F.lit(0.5)
        for kind in sorted({k for k, _, _ in n}):
            yes, no = n[kind, "", 0]
            odds = F.lit((yes + 1) / (no + 1))
            for v in VOTES:
                got = [n.get((kind, v, side), (0, 0)) for side in (0, 1)]
                share = [[(got[side][y] + 1) / (got[0][y] + got[1][y] + 2) for y in (0, 1)] for side in (0, 1)]
                odds = odds * F.when(F.col(v) == 0, share[0][0] / share[0][1]).when(F.col(v) == 1, share[1][0] / share[1][1]).otherwise(1.0)
            p = F.when(F.col("kind") == kind, odds / (1 + odds)).otherwise(p)
    return counts.withColumn("p", p)


def _features(get) -> list[Column]:
    """Kind and votes as zeros and ones."""
    kinds = [(get("kind") == k).cast("double") for k in range(len(KINDS))]
    return kinds + [(get(v) == side).cast("double") for v in VOTES for side in (0, 1)]


def train(estimated: DataFrame) -> list[float] | None:
    """Weights and intercept of the span classifier, from both classes of each vote combination weighted by
    their probability; None without any candidate."""
    names = [f"f{i}" for i in range(len(KINDS) + 2 * len(VOTES))]
    rows = estimated.select(*[x.alias(n) for n, x in zip(names, _features(F.col), strict=True)], "n", "p")
    sides = F.inline(F.array(
        F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")),
    ))
    rows = rows.select(*names, sides).where("weight > 1e-9")
    if rows.isEmpty():
        return None
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    model = LogisticRegression(weightCol="weight", regParam=1e-4, maxIter=50).fit(vectors)
    return [*map(float, model.coefficients), float(model.intercept)]


def select_spans(found: Column, weights: list[float] | None, threshold: float = 0.5) -> Column:
    """Exact spans, and those the classifier adds that overlap none of them, by start and kind."""
    base = F.filter(found, lambda s: s["base"])
    plain = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    kept = F.transform(base, plain)
    if weights is not None:

        def probable(s):
            logit = reduce(lambda a, b: a + b, [x * w for x, w in zip(_features(lambda c: s[c]), weights, strict=False)])
            clear = ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
            return ~s["base"] & (1 / (1 + F.exp(-(logit + weights[-1]))) >= threshold) & clear

        kept = F.concat(kept, F.transform(F.filter(found, probable), plain))
    return F.array_sort(kept)


def of_kind(spans: Column, kind: int) -> Column:
    """How many spans are of a kind. The lambda takes one argument only: a second one would be the index."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``): ``base`` and ``spans``, arrays of (start, kind number,
    end) in characters, end exclusive.

    ``base`` holds the leftmost non-overlapping matches of each kind's pattern that pass its check;
    ``spans`` also what the classifier adds. Null and empty texts have none, repeated rows get the same,
    an empty table gives no rows. Other columns are not read.
    """
    found = materialize(candidates(docs))
    counts = materialize(vote_counts(found).coalesce(1))
    weights = train(materialize(estimate(counts)))
    return found.select(
        "doc_id",
        select_spans(F.col("found"), None).alias("base"),
        select_spans(F.col("found"), weights, threshold).alias("spans"),
    )


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with all its columns; in ``text`` each span, or run of overlapping spans, is replaced by the
    first one's kind in brackets, such as ``[EMAIL]``. Cases as in :func:`find`; a null text stays null."""
    names = docs.columns
    held = materialize(candidates(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text")), ["row", "text"]))
    counts = materialize(vote_counts(held).coalesce(1))
    weights = train(materialize(estimate(counts)))
    spans = select_spans(F.col("found"), weights, threshold)
    tag = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def step(acc, s):
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.concat(acc["parts"], F.array(F.concat(gap, F.get(tag, s["kind"]))))
        return F.struct(
            F.when(s["start"] >= acc["at"], fresh).otherwise(acc["parts"]).alias("parts"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    empty = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at"))
    rows = held.select("row", "text", spans.alias("spans")).withColumn("done", F.aggregate("spans", empty, step))
    rest = F.substring(F.col("text"), (F.col("done.at") + 1).cast("int"), F.length("text"))
    clean = F.when(F.size("spans") > 0, F.concat(F.array_join("done.parts", ""), rest)).otherwise(F.col("text"))
    return rows.select(*[clean.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in names])
