"""Personal data by weak supervision, in DataFrame functions alone.

Patterns find candidate spans. Labelers - a pattern's own check, gazetteers, the words before and
the characters around a span - vote for, against or not at all. Expectation-maximisation over
how often each pattern of votes occurs estimates how reliable each labeler is; the resulting
probabilities train the span classifier, a logistic regression on features of the span. Texts
are read once; what comes after works on the candidates. Only counts of patterns, of which
there is a bounded number, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import staged

# The kinds in their order, and their patterns. \G and the look-behinds only keep
# the engine from trying every start within one run; possessive loops keep it from recursing.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns, whose matches are candidates only.
WIDE = {
    "hidden_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,6}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+.-])(?<!\+[0-9]{1,3} )\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?(?![0-9A-Za-z])",
    "titled_name": r"(?<![0-9A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?(?![A-Za-z])",
}
KINDS = (*BASE, *WIDE)

# Gazetteers. Common endings of domains, dialling codes, lands that have IBANs with their lengths, first names.
DOMAINS = (
    "com org net edu gov mil int io co ai app dev info biz name pro tech online site store example test"
    " ar at au be bg br ca ch cl cn cz de dk ee es eu fi fr gr hk hr hu ie il in is it jp kr lt lu lv mx my nl no nz pl pt ro rs ru se sg si sk th tr tw ua uk us za"
)
DIALLING = (
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
    " 212 213 216 218 220 221 225 233 234 237 244 249 250 251 254 255 256 260 263 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 382 385 386 387 389"
    " 420 421 423 500 501 502 503 504 505 506 507 591 592 593 595 598 673 679 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998"
)
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27"
    " JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
FIRST_NAMES = (
    "Aaron Adam Alan Albert Alex Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Ann Anna Anne Anthony Antonio Barbara Ben Benjamin Bernd Bob Brian Carla Carlos Carmen Carol Catherine"
    " Charles Charlotte Chiara Christian Christine Christopher Claire Claudia Clara Daniel David Deborah Dennis Diana Diego Donald Edward Elena Elias Elizabeth Ella Emily Emma Eric Erik Eva Fatima Felix"
    " Fernando Francesca Francesco Francisco Frank Franz Gary George Georg Giulia Giovanni Grace Hanna Hans Heather Helen Helena Henry Hugo Ian Ines Isabel Isabella Ivan Jack Jacob James Jan Jane Janet"
    " Jason Javier Jean Jennifer Jessica Joan Johann John Jonas Jonathan Jorge Jose Joseph Juan Julia Julie Karen Karl Katharina Kevin Klaus Larry Laura Lena Leo Lily Linda Lisa Louis Lucas Lucia Luis"
    " Lukas Marco Margaret Maria Marie Mark Markus Marta Martin Mary Matthew Max Maximilian Mia Michael Michel Miguel Monica Nancy Nathan Nicholas Nicole Nina Noah Oliver Olivia Oscar Pablo Patricia Patrick Paul"
)
CUES = r"(?i)(?:e-?mail|mail|contact|call|phone|tel|mobile|fax|card|visa|iban|account|ssn|social|host|address|name|sincerely)\W{0,4}$"
COUNTER_CUES = r"(?i)(?:version|ver|v|order|invoice|isbn|ref|no|nr|id|rev|build|part|section|figure|table)\W{0,3}$"

VOTES = ("check", "gazetteer", "context", "edges", "variety")
THRESHOLD = 0.5
#: How often a labeler is taken to be right before its votes are counted and how many votes that weighs; the same of a
#: pattern's own check; and the spans that an even start of each kind weighs.
RIGHT, WEIGHT, CHECKED, EVEN = 0.75, 20.0, (0.98, 1000.0), 100.0
#: Characters of context that a candidate carries.
BEFORE, AFTER = 24, 2


def _among(value: Column, words: str) -> Column:
    return value.isin(*words.split())


def candidates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per candidate - and one with a null kind for a document without any.

    Columns: row, doc_id, kind (its number), pos, skipped (characters between the previous match of
    the kind and this one), found, before, after.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lean = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    patterns = list({**BASE, **WIDE}.values())
    found = lean.select("row", "doc_id", "text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(patterns)])

    def pairs(k: int, p: str) -> Column:
        # A text with n matches splits into n + 1 gaps.
        gaps = F.split("text", p, -1)
        zipped = F.transform(
            F.arrays_zip(F.col(f"m{k}").alias("found"), F.slice(gaps, 1, F.size(f"m{k}")).alias("gap"), F.slice(gaps, 2, F.size(f"m{k}")).alias("next")),
            lambda x, i: F.struct(
                F.lit(k).alias("kind"),
                i.alias("pos"),
                F.length(x["gap"]).alias("skipped"),
                x["found"].alias("found"),
                F.right(x["gap"], F.lit(BEFORE)).alias("before"),
                F.left(x["next"], F.lit(AFTER)).alias("after"),
            ),
        )
        return F.when(F.size(f"m{k}") > 0, zipped).otherwise(F.array().cast("array<struct<kind:int,pos:int,skipped:int,found:string,before:string,after:string>>"))

    every = F.concat(*[pairs(k, p) for k, p in enumerate(patterns)])
    return found.select("row", "doc_id", F.inline_outer(every))


def _digits() -> Column:
    return F.regexp_replace("found", "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    parts = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes() -> Column:
    """The base check of a candidate of a base kind; null for the wider kinds."""
    kind, digits = F.col("kind"), _digits()
    parts = F.split("found", "\\.")
    small = F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(parts, lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(999)) <= 255)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, small)
        .when(kind == 2, F.length(digits).between(16, 19) & luhn(digits))
        .when(kind == 3, F.length(digits).between(8, 15))
    )


def _own_check() -> Column:
    """What a number of a wider kind says of itself: an IBAN's remainder, parts of a national id that are never given."""
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    letters = F.replace("found", F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.expr("substring(replace(found, ' ', ''), 5)"), F.left(letters, F.lit(4))), "")
    digit = lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - 55)
    rest = F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(digit(c) > 9, 100).otherwise(10) + digit(c)) % 97)
    return F.when(name == "iban", rest == 1).when(name == "national_id", ~F.col("found").rlike("^(?:000|666|9)|-00-|-0000$"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), 1).when(F.coalesce(bad, F.lit(False)), -1).otherwise(0)


def voted(cands: DataFrame) -> DataFrame:
    """Candidates with ok (the base check), the labelers' votes and the classifier's features."""
    name = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    digits, n = _digits(), F.length("found")
    dialled = F.regexp_extract("found", r"^\+([0-9]{1,3})", 1)
    listed = (
        F.when(name == "email", _among(F.lower(F.regexp_extract("found", r"\.([A-Za-z0-9-]+)$", 1)), DOMAINS))
        .when(name == "hidden_email", _among(F.lower(F.regexp_extract("found", r"([A-Za-z]+)$", 1)), DOMAINS))
        .when(name == "ip", ~F.col("found").rlike(r"^(?:0|10|127|192\.168|169\.254|2[2-5][0-9])\."))
        .when(name == "card", F.length(digits).between(13, 19) & digits.rlike(r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"))
        .when(name == "phone", F.exists(F.array(*[F.left(dialled, F.lit(k)) for k in (1, 2, 3)]), lambda p: _among(p, DIALLING)))
        .when(name == "iban", _among(F.concat(F.left("found", F.lit(2)), F.length(F.replace("found", F.lit(" ")))), IBAN_LENGTHS))
        .when(name == "titled_name", F.exists(F.split("found", " "), lambda w: _among(w, FIRST_NAMES)))
    )
    ok = passes()
    around = F.col("before").rlike("[A-Za-z0-9]$") | F.col("after").rlike("^[A-Za-z0-9]")
    apart = F.size(F.array_distinct(F.split(digits, "")))
    return cands.filter("kind IS NOT NULL").select(
        "*",
        F.coalesce(ok, F.lit(False)).alias("ok"),
        _vote(F.coalesce(ok, _own_check()), ~F.coalesce(ok, _own_check())).alias("check"),
        _vote(listed, ~listed).alias("gazetteer"),
        _vote(F.col("before").rlike(CUES), F.col("before").rlike(COUNTER_CUES)).alias("context"),
        # The wider patterns see to their edges themselves.
        _vote(~around & (F.col("kind") < len(BASE)), around).alias("edges"),
        _vote((F.length(digits) >= 7) & (apart >= 4), (F.length(digits) >= 7) & (apart <= 2)).alias("variety"),
        F.least(F.floor(n / 4), F.lit(7)).cast("int").alias("size"),
        F.floor(F.length(digits) * 4 / F.greatest(n, F.lit(1))).cast("int").alias("share"),
        F.least(F.length(F.regexp_replace("found", "[A-Za-z0-9]", "")), F.lit(5)).cast("int").alias("marks"),
    )


FEATURES = ("kind", "size", "share", "marks", "context", "edges", "gazetteer", "check")


def estimate(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 40) -> dict[tuple[int, tuple[int, ...]], float]:
    """The probability that a span is personal data, by kind and votes.

    Expectation-maximisation of one probability for each kind, and for each kind and labeler the
    probabilities of its votes for and against on true and on false spans; it begins at the majority of votes.
    A labeler that doesn't vote says nothing. Before its votes are counted a labeler is taken to be right RIGHT of the
    time, which weighs WEIGHT votes (a pattern's own check more), and a kind to be half true, which weighs EVEN spans:
    kinds of which there is little to learn stay near the majority.
    """
    truth = {(k, v): min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for k, v, _ in patterns}
    for _ in range(rounds):
        kinds: dict[int, list[float]] = {}
        votes: dict[tuple[int, int], dict[tuple[int, int], float]] = {}
        for k, v, n in patterns:
            p = truth[k, v]
            total = kinds.setdefault(k, [EVEN / 2, EVEN / 2])
            total[0] += n * (1 - p)
            total[1] += n * p
            for which, s in enumerate(v):
                if s:
                    right, weight = (CHECKED if VOTES[which] == "check" else (RIGHT, WEIGHT))
                    held = votes.setdefault((k, which), {(x, y): weight * (right if (x > 0) == (y > 0) else 1 - right) for x in (-1, 1) for y in (0, 1)})
                    held[s, 1] += n * p
                    held[s, 0] += n * (1 - p)
        share = lambda k, w, s, y: votes[k, w][s, y] / (votes[k, w][-1, y] + votes[k, w][1, y])  # noqa: B023, E731
        for k, v, _ in patterns:
            logs = [math.log(kinds[k][y] / sum(kinds[k])) + sum(math.log(share(k, w, s, y)) for w, s in enumerate(v) if s) for y in (0, 1)]
            truth[k, v] = 1 / (1 + math.exp(min(60.0, max(-60.0, logs[0] - logs[1]))))
    return truth


def classifier(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> dict[tuple[int, int], float]:
    """Weights by (feature, value) of a logistic regression on (values, probability, count)."""
    weights: dict[tuple[int, int], float] = {(-1, 0): 0.0}
    total = sum(n for _, _, n in rows) or 1.0
    keys = [[(-1, 0), *enumerate(v)] for v, _, _ in rows]
    for ks in keys:
        for k in ks:
            weights.setdefault(k, 0.0)
    squares = dict.fromkeys(weights, 1e-8)
    for _ in range(rounds):
        slope = {k: ridge * w for k, w in weights.items()}
        for ks, (_, p, n) in zip(keys, rows):
            z = sum(weights[k] for k in ks)
            error = (1 / (1 + math.exp(min(60.0, max(-60.0, -z)))) - p) * n / total
            for k in ks:
                slope[k] += error
        for k, g in slope.items():
            squares[k] += g * g
            weights[k] -= rate * g / math.sqrt(squares[k])
    return weights


def probability(weights: dict[tuple[int, int], float]) -> Column:
    """The classifier as a column over the features of `voted`."""
    z = F.lit(float(weights[-1, 0]))
    for f, name in enumerate(FEATURES):
        known = sorted((v, w) for (g, v), w in weights.items() if g == f)
        if known:
            table = F.create_map(*[F.lit(x) for v, w in known for x in (int(v), float(w))])
            z = z + F.coalesce(table[F.col(name)], F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def train(scored: DataFrame) -> dict[tuple[int, int], float]:
    """Labeler reliabilities by EM, then the classifier, from counts of all candidates' patterns."""
    counts = scored.groupBy(*dict.fromkeys((*FEATURES, *VOTES))).count().collect()
    votes: dict[tuple[int, tuple[int, ...]], float] = {}
    for r in counts:
        key = (r["kind"], tuple(r[v] for v in VOTES))
        votes[key] = votes.get(key, 0.0) + r["count"]
    truth = estimate(sorted((k, v, n) for (k, v), n in votes.items()))
    rows = [(tuple(r[f] for f in FEATURES), truth[r["kind"], tuple(r[v] for v in VOTES)], float(r["count"])) for r in counts]
    return classifier(sorted(rows))


def _of_kind(k: int):
    return lambda span: span["kind"] == k


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts, a digest of the base spans, all spans, and n_weak.

    A base span is one that passes its kind's check; it always stays. The classifier adds
    candidates that meet no base span, under `weak_<kind>`; those may overlap one another. Null and
    empty texts have no spans. Spans that begin together are ordered by their end. Repeated rows give
    a row each, null ids stay null, other columns are not read, an empty table gives no rows. A text is
    matched in one task; positions are running sums over its own matches, and overlaps are found by
    two running extremes over them in order, so time grows with its length and the logarithm of its
    matches.
    """
    cands = staged(candidates(docs, text_col, id_col), "candidates")
    scored = voted(cands)
    weights = train(scored)
    fixed = F.col("kind") < len(BASE)
    rank = F.when(fixed & F.col("ok"), 0).when(probability(weights) >= threshold, 1).otherwise(2)
    none = F.lit(None).cast("int")
    judged = scored.select("row", "doc_id", "kind", "pos", "skipped", "found", rank.alias("rank"))
    without = cands.filter("kind IS NULL").select("row", "doc_id", "kind", "pos", "skipped", "found", none.alias("rank"))
    order = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # One shuffle: the windows and the grouping are all within a row of the input.
    spans = judged.unionByName(without).repartition("row").withColumn("end", F.sum(F.col("skipped") + F.length("found")).over(order))
    spans = spans.withColumn("start", F.col("end") - F.length("found"))
    # Spark works frames that run to the partition's end out anew for each row, so the way back is a window of its own.
    there, back = (Window.partitionBy("row").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("start"), F.desc("start")))
    base_end = F.max(F.when(F.col("rank") == 0, F.col("end"))).over(there)
    base_start = F.min(F.when(F.col("rank") == 0, F.col("start"))).over(back)
    meets = F.coalesce(base_end > F.col("start"), F.lit(False)) | F.coalesce(base_start < F.col("end"), F.lit(False))
    spans = spans.withColumn("apart", ~meets)
    span = F.struct("kind", "start", "end")
    grouped = spans.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.array_sort(F.collect_list(F.when(F.col("rank") == 0, span))).alias("base"),
        F.array_sort(F.collect_list(F.when((F.col("rank") == 1) & F.col("apart"), span))).alias("weak"),
    )
    names = F.array(*[F.lit(k) for k in BASE], *[F.lit(f"weak_{k}") for k in KINDS])
    said = lambda spans, shift: F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1 + shift), s["start"], s["end"]))
    base = F.array_join(said(F.col("base"), 0), ",")
    return grouped.select(
        "doc_id",
        *[F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(said(F.col("base"), 0), said(F.col("weak"), len(BASE))), ",").alias("spans"),
        F.size("weak").cast("long").alias("n_weak"),
    )
