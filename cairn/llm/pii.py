"""Personal data by weak supervision, in DataFrame expressions only.

Candidates of every kind are found with one pattern each. Three labelers vote on a candidate: a strict
format (regex), a word list for what stands before or inside it (gazetteer), and how it stands in the
text (context: set off, and neither named as a digest or a file, nor like a digest, nor made of words). A pattern is a
candidate's kind, its votes and its features (whether it is assigned or quoted, words inside, character
classes, separators, length, what stands before and behind it). Patterns are counted, so at most a few thousand rows come to the driver. There,
EM (two classes, one sensitivity and specificity for each labeler and kind, which begin as presumed and
keep ``PRESUMED_VOTES`` of that beside what is counted) gives each vote pattern a probability, and a logistic span classifier over votes and features
is trained on those probabilities. Its verdict for each pattern is applied to all candidates.

Base spans (email, ip, card, phone by fixed rules) always stay. The classifier adds spans of the kinds
``secret`` (passwords, tokens and keys), ``iban`` (account numbers, whose format vote is the check by 97) and
``national_id`` (numbers in the form of the social security's). What a kind's pattern finds is only a candidate: without format or word list it is seldom accepted.

Patterns are written with possessive repeats and start only where the fixed pattern could, and positions
are prefix sums in blocks of ``STEP``, so work is in proportion to the text but for a term of the square
of (matches / ``STEP``).

Positions are code points, end exclusive. Defined results: a null or empty text has no spans; spans that
start together are listed by kind; repeated rows are repeated in the result; a null doc_id stays null; an
empty table gives an empty result; very long texts are one value of a row each, worked on whole. Other
columns may have any name: rows travel boxed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from cairn.runtime import materialize

#: Base kinds in the order in which ties at one start are listed, then the kinds that the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "national_id")
#: The fixed patterns of the base kinds; (?:\G|(?<!x)) keeps a search from starting inside a run again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{12,}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]{4}){2,7}+(?:[\x20]?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Something that every match holds, looked for first.
TRIGGERS = {"email": "@", "ip": ".", "phone": "+", "national_id": "-"}
GAZETTEER = {
    "email": r"(?i)(?:mail|post|inbox|contact|info)",
    "ip": r"(?i)(?:\bip|host|server|address|addr)\W*$",
    "card": r"(?i)(?:card|visa|credit|amex)\W*$",
    "phone": r"(?i)(?:tel|phone|call|mobile|fax)\W*$",
    "secret": r"(?i)(?:passw(?:or)?d|passwort|pwd|token|secret|(?:api|access|private|auth)[_ -]?key|auth|credential|bearer)s?\s*[\"']?\s*(?:[=:]|\bis\b|\s)\s*[\"']?$",
    "iban": r"(?i)(?:iban|account|acct|konto|bank|transfer to)\b[^A-Za-z0-9]*(?:(?:no|number|nr|is|to)\b[^A-Za-z0-9]*)?$",
    "national_id": r"(?i)(?:\bssn|social security|national id|tax(?:payer)? id|\btin)\b[^A-Za-z0-9]*(?:(?:no|number|is)\b[^A-Za-z0-9]*){0,2}$",
}
#: Published formats of keys and tokens (fixed values).
STRICT = {
    "secret": r"^(?:A(?:KI|SI)A[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk[-_][A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{20,})$",
}
#: What names a digest, a file or a number that is no secret, right before it; a file's ending right behind it.
HARMLESS = r"(?i)(?:commit|sha-?[0-9]*|md5|digest|checksum|hash|rev(?:ision)?|etag|uuid|id|file|image|img|path|href|src|version|build|isbn|doi)\W*$|[/.\\]$"
ENDING = r"^\.[A-Za-z0-9]{1,5}\b"
WORDS = r"(?:^|[_/-])[A-Za-z][a-z]{3,}[0-9]*(?:[_/-]|$)"
#: Hex digits of common digests; a run of that length that nothing assigns looks like one.
DIGESTS = (32, 40, 56, 64, 96, 128)
SHAPES = 4
LEFT, RIGHT = 32, 6
STEP = 64
#: Presumed shares of personal data that format, word list and context vote for, and of the rest that they pass, and how
#: many votes that presumption counts for. Few other strings have a published format; many are set off.
PRESUMED = ((0.5, 0.7, 0.95), (0.999, 0.97, 0.5))
PRESUMED_VOTES = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array of integers (0 or more) by ``op``, each with its own element, in blocks of ``STEP``."""
    whole = lambda c: c.cast("int")
    zero = F.lit(0)

    def of_blocks(v: Column) -> Column:
        blocks = F.sequence(zero, whole(F.floor((F.size(v) - 1) / STEP)))
        totals = F.transform(blocks, lambda b: F.aggregate(F.slice(v, b * STEP + 1, F.lit(STEP)), zero, op))
        ahead = lambda t: F.transform(t, lambda _, b: F.aggregate(F.slice(t, F.lit(1), b), zero, op))
        each = lambda before: F.transform(v, lambda _, i: F.aggregate(F.slice(v, whole(F.floor(i / STEP)) * STEP + 1, i % STEP + 1), F.get(before, whole(F.floor(i / STEP))), op))
        return let(totals, lambda t: let(ahead(t), each))

    return F.when(F.size(values) > 0, let(values, of_blocks)).otherwise(F.array().cast("array<int>"))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    figures = F.split(F.reverse(digits), "")
    value = lambda x, i: F.when(i % 2 == 0, x.cast("int")).when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)
    return F.aggregate(F.transform(figures, value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """Whether a base pattern's match is a base span."""
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?!$)|$)){4}$")
    n = F.char_length(digits_of(match))
    if kind == "card":
        return n.between(14, 19) & luhn(digits_of(match))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def remainder_97(account: Column) -> Column:
    """Remainder by 97 of an account number: its first four characters moved behind, letters read as 10 to 35."""
    own = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(own, F.lit(5)), F.left(own, F.lit(4)))
    step = lambda a, x: F.when(x.rlike("^[0-9]$"), a * 10 + x.cast("int")).otherwise(a * 100 + F.ascii(x) - 55) % 97
    return F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), lambda a, x: step(a, x).cast("int"))


def formatted(kind: str, match: Column) -> Column:
    """The format labeler's vote on a candidate of an added kind."""
    if kind == "iban":
        return F.char_length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34) & (remainder_97(match) == 1)
    if kind == "national_id":
        return match.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    return match.rlike(STRICT[kind])


SPAN = "array<struct<start:int,end:int,match:string,left:string,right:string>>"


def find_matches(rows: DataFrame, text: str) -> DataFrame:
    """Adds for each kind a column ``m_<kind>`` of that kind's pattern matches with their positions (``SPAN``).

    ``split`` by the pattern gives what lies between the matches, so lengths add up to positions.
    Each step is a projection of its own, so that no pattern runs more than once for a text.
    """
    none = F.array().cast("array<string>")
    found = {}
    for kind in KINDS:
        hits = F.regexp_extract_all(F.col(text), F.lit(PATTERNS[kind]), F.lit(0))
        found[f"f_{kind}"] = F.when(F.contains(F.col(text), F.lit(TRIGGERS[kind])), hits).otherwise(none) if kind in TRIGGERS else hits
    rows = rows.withColumns(found)
    rows = rows.withColumns({f"g_{kind}": F.when(F.size(f"f_{kind}") > 0, F.split(F.col(text), PATTERNS[kind], -1)) for kind in KINDS})

    def placed(kind: str) -> Column:
        gaps = F.col(f"g_{kind}")
        zipped = F.filter(F.arrays_zip(gaps.alias("gap"), F.col(f"f_{kind}").alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps) - 1).alias("after")), lambda z: z["hit"].isNotNull())

        def spans(z: Column) -> Column:
            ends = running(F.transform(z, lambda x: F.char_length(x["gap"]) + F.char_length(x["hit"])), lambda a, x: a + x)
            one = lambda end, x: F.struct((end - F.char_length(x["hit"])).alias("start"), end.alias("end"), x["hit"].alias("match"), F.right(x["gap"], F.lit(LEFT)).alias("left"), F.left(x["after"], F.lit(RIGHT)).alias("right"))
            return F.zip_with(ends, z, one)

        return F.when(gaps.isNull(), F.array().cast(SPAN)).otherwise(let(zipped, spans))

    rows = rows.withColumns({f"m_{kind}": placed(kind) for kind in KINDS})
    return rows.drop(*(f"{c}_{kind}" for kind in KINDS for c in "fg"))


def _shape(match: Column) -> Column:
    n = F.char_length(match)
    return F.when(n < 16, 0).when(n < 20, 1).when(n < 32, 2).otherwise(3)


def _candidate(kind: str, m: Column) -> Column:
    """start, kind's number, end, and the pattern: three votes, then length and features."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("string")
    apart = ((m["left"] == "") | m["left"].rlike(r"[\s(\[<\"'=:,;]$")) & ((m["right"] == "") | m["right"].rlike(r"^[\s)\]>\"'.,;:!?]"))
    if kind in BASE:
        strict, listed = valid(kind, m["match"]), m["left"].rlike(GAZETTEER[kind]) | (m["match"].rlike(GAZETTEER[kind]) if kind == "email" else F.lit(False))
        context, features = apart, ()
    elif kind != "secret":
        strict, listed = formatted(kind, m["match"]), m["left"].rlike(GAZETTEER[kind])
        context, features = apart & ~m["left"].rlike(HARMLESS), ()
    else:
        wordy, harmless = m["match"].rlike(WORDS), m["left"].rlike(HARMLESS) | m["right"].rlike(ENDING)
        strict, listed = formatted(kind, m["match"]), m["left"].rlike(GAZETTEER[kind])
        assigned, hexes = m["left"].rlike(r"(?:[=:]\s*|[\"'])$"), m["match"].rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
        digest = hexes & ~assigned & F.char_length(m["match"]).isin(*DIGESTS)
        context = apart & ~harmless & ~wordy & ~digest
        features = (assigned, wordy, harmless, hexes, m["match"].rlike("[a-z]") & m["match"].rlike("[A-Z]"), m["match"].rlike("[_+/-]"))
    return F.struct(
        m["start"].alias("start"),
        F.lit(KINDS.index(kind)).alias("kind"),
        m["end"].alias("end"),
        F.concat(flag(strict), flag(listed), flag(context), F.lit("/"), _shape(m["match"]).cast("string"), *map(flag, features)).alias("votes"),
    )


def _voter(kind: str):
    return lambda m: _candidate(kind, m)


def _of_kind(number: int):
    return lambda c: c["kind"] == number


def find_candidates(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``cands``: every match of every kind, ordered by start, then kind."""
    rows = find_matches(rows, text)
    every = [F.transform(f"m_{kind}", _voter(kind)) for kind in KINDS]
    return rows.withColumn("cands", F.array_sort(F.concat(*every))).drop(*(f"m_{kind}" for kind in KINDS))


def reliabilities(votes: dict[str, int], rounds: int = 300) -> tuple[float, list[float], list[float], dict[str, float]]:
    """EM over one kind's counted votes: share of personal data, sensitivities, specificities, and each pattern's probability.

    The presumption is a prior of ``PRESUMED_VOTES`` votes for each class, which counts outgrow; it also begins the
    rounds, so it is what tells the classes apart. The classes' odds are taken to be even at most, so that a table in which
    nearly every candidate is personal data doesn't teach that all are.
    """
    post: dict[str, float] = {}
    share, (sens, spec) = 0.5, PRESUMED
    for _ in range(rounds):
        for v in votes:
            p, q = share, 1 - share
            for i in range(3):
                p *= sens[i] if v[i] == "1" else 1 - sens[i]
                q *= 1 - spec[i] if v[i] == "1" else spec[i]
            post[v] = p / (p + q)
        yes = sum(n * post[v] for v, n in votes.items())
        no = sum(n * (1 - post[v]) for v, n in votes.items())
        share = min(0.5, (yes + 1) / (yes + no + 2))
        rate = lambda presumed, hits, of: (hits + PRESUMED_VOTES * presumed) / (of + PRESUMED_VOTES)
        sens = [rate(PRESUMED[0][i], sum(n * post[v] for v, n in votes.items() if v[i] == "1"), yes) for i in range(3)]
        spec = [rate(PRESUMED[1][i], sum(n * (1 - post[v]) for v, n in votes.items() if v[i] == "0"), no) for i in range(3)]
    return share, list(sens), list(spec), post


def estimate(counts: dict[tuple[int, str], int]) -> dict[tuple[int, str], float]:
    """For each (kind, pattern) the probability, by the kind's EM, that such a candidate is personal data."""
    out: dict[tuple[int, str], float] = {}
    for kind in sorted({k for k, _ in counts}):
        own: dict[str, int] = {}
        for (k, votes), n in counts.items():
            if k == kind:
                own[votes[:3]] = own.get(votes[:3], 0) + n
        post = reliabilities(own)[3]
        out |= {(k, votes): post[votes[:3]] for k, votes in counts if k == kind}
    return out


def train(counts: dict[tuple[int, str], int], targets: dict[tuple[int, str], float], steps: int = 1500, rate: float = 0.25) -> dict[tuple[int, str], float]:
    """A logistic classifier over votes (alone and in pairs), length and features of each kind, fitted to the EM probabilities."""

    def features(key: tuple[int, str]) -> list[tuple]:
        kind, votes = key
        pairs = [(kind, i, j, votes[i] + votes[j]) for i in range(3) for j in range(i)]
        return [(kind,), *((kind, i, votes[i]) for i in range(3)), *pairs, *((kind, "f", i, x) for i, x in enumerate(votes[4:]))]

    weights: dict[tuple, float] = {}
    size = {k: math.log1p(n) for k, n in counts.items()}
    total = {kind: sum(n for (k, _), n in size.items() if k == kind) for kind, _ in counts}
    margin = lambda k: sum(weights.get(f, 0.0) for f in features(k))
    chance = lambda k: 1 / (1 + math.exp(-max(-30.0, min(30.0, margin(k)))))
    for _ in range(steps):
        slope: dict[tuple, float] = {}
        for k in counts:
            gap = size[k] * (targets[k] - chance(k)) / total[k[0]]
            for f in features(k):
                slope[f] = slope.get(f, 0.0) + gap
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) + rate * g
    return {k: chance(k) for k in counts}


def fit(candidates: DataFrame) -> list[str]:
    """The accepted patterns, as "kind:votes", from all candidates of all rows."""
    seen = candidates.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes").count().collect()  # a row for each pattern, 8 * 4 * 64 of a kind at most
    counts = {(r["kind"], r["votes"]): r["count"] for r in seen}
    return sorted(f"{k}:{v}" for (k, v), p in train(counts, estimate(counts)).items() if p >= 0.5)


def _spans(accepted: list[str]) -> tuple[Column, Column]:
    """Base spans and all spans of ``cands``: base kinds by their fixed rule, the others by the classifier."""
    base = F.filter("cands", lambda c: (c["kind"] < len(BASE)) & F.startswith(c["votes"], F.lit("1")))
    added = lambda c: (c["kind"] >= len(BASE)) & F.concat(c["kind"].cast("string"), F.lit(":"), c["votes"]).isin(accepted)
    return base, F.filter("cands", lambda c: ((c["kind"] < len(BASE)) & F.startswith(c["votes"], F.lit("1"))) | added(c))


def _listing(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and how many of them there are, of every whole text."""
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = materialize(find_candidates(own).select("doc_id", "cands"), "candidates")
    base, every = _spans(fit(found))
    out = found.select("doc_id", base.alias("base"), every.alias("every"))
    counted = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return out.select("doc_id", *counted, F.sha2(_listing(F.col("base")), 256).alias("base_sha256"), _listing(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))


#: Code points of the parts that a text is cut into before spans are taken out of it.
PART = 1024


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with the spans replaced by their kinds; overlapping ones by that of the first."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    whole = lambda c: c.cast("int")

    def cut(parts: Column, start: Column, end: Column) -> Column:
        low = whole(F.floor(start / PART))
        own = F.array_join(F.slice(parts, low + 1, whole(F.floor(end / PART)) - low + 1), "")
        return F.when(end > start, F.substr(own, start - low * PART + 1, end - start)).otherwise("")

    def join(parts: Column) -> Column:
        def by_reach(reach: Column) -> Column:
            before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
            one = lambda c, i: F.when(c["start"] >= before(i), F.concat(cut(parts, before(i), c["start"]), F.get(names, c["kind"]))).otherwise("")
            return F.concat(F.array_join(F.transform(spans, one), ""), cut(parts, F.element_at(reach, -1), F.char_length(text)))

        return let(running(F.transform(spans, lambda c: c["end"]), lambda a, x: F.greatest(a, x)), by_reach)

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)), join)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data in ``text`` replaced by its kind in brackets.

    Where spans overlap, the one that begins first (ties: the kind listed first) stands for both. A
    null text stays null. Where there is a column n_chars, it follows the new text.
    """
    boxed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = materialize(find_candidates(boxed).select("row", "cands"), "candidates")
    _, every = _spans(fit(found))
    rows = found.select("row", F.col("row.text").cast("string").alias("text"), every.alias("spans"))
    rows = rows.select("row", "spans", F.when(F.size("spans") > 0, _replaced(F.col("text"), F.col("spans"))).alias("new"))
    changed = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.char_length("new").cast(docs.schema["n_chars"].dataType))
    return rows.select(F.when(F.col("new").isNotNull(), changed).otherwise(F.col("row")).alias("row")).select("row.*")
