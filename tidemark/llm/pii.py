"""Personal data and secrets by weak supervision, in DataFrame functions only.

Candidates come from strict patterns (email, ip, card, phone), from looser ones (masked emails, national phone numbers,
IPv6, oddly separated cards), from context (numbers behind a word for a telephone) and from gazetteers (assignments to a
name that credentials have, account numbers behind a country code, national ids). Five labelers vote -1, 0 or 1 on
each: strict regex with its check, shape or checksum, gazetteer (``data/``: domains, calling codes, issuers, credential
prefixes), words before, and isolation. Expectation-maximisation over the distinct vote patterns (at most 3^5 rows,
whatever the input) estimates each labeler's reliability. Its posteriors train a naive Bayes span classifier on
span features; the classifier decides which of the other spans are added. Strict spans that pass their check always stay.

All is narrow: the hits of a text are an array in its own row, with positions by block-wise running sums, and the model
is literals. Only counts of feature tuples are shuffled. Null text counts as empty and has no spans; null or repeated ids
are rows of their own, an empty table gives no rows and no model. Patterns use possessive loops, so that long runs neither
recurse nor rescan. Only the id and the text column are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, own_columns, staged

KINDS = ("email", "ip", "card", "phone", "secret", "iban", "id")
BASE_KINDS = KINDS[:4]


def gazetteer(name: str) -> list[str]:
    """Entries of a data file: words apart from comment lines."""
    lines = (Path(__file__).parent / "data" / f"{name}.txt").read_text().splitlines()
    return [word for line in lines if not line.startswith("#") for word in line.split()]


_LOCAL = r"[A-Za-z0-9._%+-]"
#: The strict patterns. Lookbehind and \G only anchor a match where the plain pattern would start it.
STRICT = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NAMES = "|".join(gazetteer("secrets"))
#: (rule, kind) -> pattern of the candidates that only the classifier can add.
OTHER = {
    ("loose", "email"): r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++",
    ("loose", "ip"): r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    ("loose", "card"): r"(?<![0-9._/])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{4}(?![0-9._/])",
    ("loose", "phone"): r"(?<![0-9+.()-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    ("context", "phone"): r"(?i)(?<=\b(?:tel|phone|mobile|cell|fax|telefon)[.:]{0,2} {0,2})[0-9](?:[ ./-]?[0-9]){5,13}+(?![0-9])",
    ("named", "secret"): rf"(?i)\b(?:{_NAMES})[\"']?\s{{0,3}}(?:=|:=|:|=>)\s{{0,3}}[\"']?[^\s\"'<>,;]{{6,}}+[\"']?",
    ("named", "iban"): r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    ("named", "id"): r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
DOMAINS = "|".join(gazetteer("domains"))
DIALLING = rf"^\+({'|'.join(gazetteer('dialling'))})"
ISSUERS = rf"^({'|'.join(gazetteer('issuers'))})"
PREFIXES = rf"^({'|'.join(gazetteer('prefixes'))})"
COUNTRY = rf"(?i)^({'|'.join(w for w in gazetteer('domains') if len(w) == 2)})"
WORDS_BEFORE = {
    "email": r"(?i)(e-?mail|mail|contact|write to|address|courriel|correo|kontakt)\W{0,4}$",
    "ip": r"(?i)(\bip|address|host|server|client|from|login)\W{0,4}$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|payment|carte|tarjeta|karte)\W{0,4}(no|number|nr)?\W{0,4}$",
    "phone": r"(?i)(tel|phone|call|mobile|cell|fax|contact|whatsapp|t[eé]l[eé]phone|tel[eé]fono|telefon)\W{0,4}$",
    "secret": r"(?i)(export|set|env|config|header|curl|const|let|var|-H|--)\W{0,4}$",
    "iban": r"(?i)(iban|account|konto|compte|cuenta|bank)\W{0,4}(no|number|nr)?\W{0,4}$",
    "id": r"(?i)(ssn|social security|insurance)\W{0,4}(no|number|nr)?\W{0,4}$",
}
WORDS_AGAINST = r"(?i)(version|ver\.|isbn|issn|order|invoice|article|ref|serial|build|§|section|part no)\W{0,4}$"
LABELERS, ROUNDS = 5, 25
VOTES = [f"v{i}" for i in range(LABELERS)]
#: Hits whose positions are summed in one go.
BLOCK = 64


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number without spaces passes its checksum: letters count 10 to 35, the first four come last."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    def add(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _blocks(items: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))


def _parts(text: Column, pattern: str, rule: str, kind: str, gate: Column) -> Column:
    """Array of (rule, kind, start, end, hit, pre, post): each match; positions in code points, end exclusive."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.array().cast("array<struct<rule:string,kind:string,start:bigint,end:bigint,hit:string,pre:string,post:string>>")
    # what follows is looked up when the pair is formed; the last gap follows the last hit
    pairs = F.filter(F.arrays_zip(gaps.alias("g"), hits.alias("h"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("n")), lambda p: p["h"].isNotNull())
    sized = F.transform(pairs, lambda p: F.struct(p["h"].alias("hit"), F.right(p["g"], F.lit(40)).alias("pre"), F.left(p["n"], F.lit(2)).alias("post"), F.length(p["h"]).cast("bigint").alias("own"), (F.length(p["g"]) + F.length(p["h"])).cast("bigint").alias("step")))
    total = lambda items: F.aggregate(items, F.lit(0).cast("bigint"), lambda a, p: a + p["step"])
    # running sums: offsets of blocks first, then inside each block
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    def placed(items: Column) -> Column:
        blocks = _blocks(items)
        offsets = F.aggregate(blocks, start, lambda a, b: F.struct((a["at"] + total(b)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        def one(z: Column) -> Column:
            def hit(p: Column, i: Column) -> Column:
                end = z["o"] + total(F.slice(z["b"], F.lit(1), i + 1))
                return F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), (end - p["own"]).alias("start"), end.alias("end"), p["hit"].alias("hit"), p["pre"].alias("pre"), p["post"].alias("post"))
            return F.transform(z["b"], hit)
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), offsets.alias("o")), one))
    # one evaluation of the matches: they are the single element of an outer array
    return F.when(gate, F.flatten(F.transform(F.filter(F.array(sized), lambda items: F.size(items) > 0), placed))).otherwise(none)


def hits_of(text: Column) -> Column:
    """Array of all candidates of a text, with their votes: (kind, start, end, valid, added, n_digits, size, v0 to v4)."""
    text = F.coalesce(text, F.lit(""))
    digit = text.rlike("[0-9]")
    gates = {
        ("strict", "email"): F.contains(text, F.lit("@")), ("strict", "phone"): F.contains(text, F.lit("+")) & digit, ("strict", "ip"): digit & text.rlike(r"[0-9]\.[0-9]"), ("strict", "card"): digit & text.rlike("[0-9][ -]?[0-9]"),
        ("loose", "email"): F.contains(text, F.lit("at]")) | F.contains(text, F.lit("at)")), ("loose", "phone"): digit & text.rlike("[0-9]{3}[ .-][0-9]{4}"), ("loose", "ip"): text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f]"), ("loose", "card"): digit & text.rlike("[0-9]{4}[._/][0-9]{4}[._/]"),
        ("context", "phone"): digit & text.rlike("[0-9][0-9 ./-]{4,}[0-9]"), ("named", "secret"): F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), ("named", "iban"): text.rlike("[A-Z]{2}[0-9]{2}"), ("named", "id"): digit & text.rlike("[0-9]-[0-9]{2}-[0-9]"),
    }
    patterns = {**{("strict", kind): p for kind, p in STRICT.items()}, **OTHER}
    return F.transform(F.concat(*[_parts(text, p, *which, gates[which]) for which, p in patterns.items()]), voted)


def voted(h: Column) -> Column:
    """A candidate with its five votes and its features, as literals and functions of its own fields."""
    hit, kind, pre = h["hit"], h["kind"], h["pre"]
    strict = h["rule"] == "strict"
    digits = F.regexp_replace(hit, "[^0-9]", "")
    n = F.length(digits)
    octets = hit.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")
    card = F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False)
    passes = F.when(kind == "email", True).when(kind == "ip", octets).when(kind == "card", card).otherwise((n >= 9) & (n <= 15))
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    value = F.regexp_replace(F.regexp_replace(hit, r"^[^=:]*+(?:=>|:=|=|:)\s*+", ""), "[\"']", "")
    account = F.regexp_replace(hit, " ", "")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    shape = (
        F.when(kind == "email", vote(F.length(hit) <= 64, F.length(hit) > 254))
        .when(kind == "ip", vote(~hit.rlike(r"(^|\.)0[0-9]"), hit.rlike(r"[0-9]{4}")))
        .when(kind == "card", vote((n == 16) | (n == 15), (n < 13) | (n > 19)))
        .when(kind == "phone", vote((n >= 10) & (n <= 13), (n < 9) | (n > 15)))
        .when(kind == "secret", vote((F.length(value) >= 16) & mixed, (F.length(value) < 8) | value.rlike("^[a-z]+$|^[0-9]{1,7}$")))
        .when(kind == "iban", vote((F.length(account) >= 15) & mod97(account), ~mod97(account)))
        .otherwise(vote(~hit.rlike("^(000|666|9)|-00-|-0000$"), hit.rlike("^(000|666|9)|-00-|-0000$")))
    )
    known = (
        F.when(kind == "email", vote(hit.rlike(rf"(?i)[.)\] ]({DOMAINS})$"), hit.rlike(r"\.[0-9]+$")))
        .when(kind == "ip", vote(hit.rlike(r"^(10|127|169\.254|172\.(1[6-9]|2[0-9]|3[01])|192\.168)\.|:"), hit.rlike(r"^(0|2[4-9][0-9])\.")))
        .when(kind == "card", vote(digits.rlike(ISSUERS), digits.rlike(r"^0|^(.)\1+$")))
        .when(kind == "phone", vote(hit.rlike(DIALLING), digits.rlike(r"^(.)\1+$")))
        .when(kind == "secret", vote(value.rlike(PREFIXES) | value.rlike("^[0-9a-fA-F]{32,}$"), value.rlike(r"(?i)example|change.?me|your|xxxx|test|dummy|\*\*\*|\$\{")))
        .when(kind == "iban", vote(account.rlike(COUNTRY), ~account.rlike(COUNTRY)))
        .otherwise(F.lit(0))
    )
    before = F.when(kind == "email", pre.rlike(WORDS_BEFORE["email"]))
    for k in KINDS[1:]:
        before = before.when(kind == k, pre.rlike(WORDS_BEFORE[k]))
    alone = vote(~pre.rlike("[A-Za-z0-9]$") & ~h["post"].rlike("^[A-Za-z0-9]"), pre.rlike("[A-Za-z0-9]$") & h["post"].rlike("^[A-Za-z0-9]"))
    votes = (vote(strict & passes, strict & ~passes), shape, known, vote(before, pre.rlike(WORDS_AGAINST)), alone)
    return F.struct(kind.alias("kind"), h["start"].alias("start"), h["end"].alias("end"), (strict & passes).alias("valid"), (~strict).alias("added"), F.least(n, F.lit(20)).alias("n_digits"), F.least(F.floor(F.length(hit) / 4), F.lit(12)).cast("int").alias("size"), *[F.coalesce(v, F.lit(0)).alias(name) for v, name in zip(votes, VOTES)])


def reliabilities(votes: DataFrame, rounds: int = ROUNDS) -> tuple[float, list[float]]:
    """(class prior, flat table P(vote | class) by labeler, class, vote) from rows v0 to v4 with a weight ``n``.

    All rounds of expectation-maximisation run inside one SQL expression over the pattern counts."""
    counts = votes.groupBy(*VOTES).agg(F.sum("n").cast("double").alias("n"))
    start = []
    for _ in range(LABELERS):
        start += [0.5, 0.3, 0.2, 0.1, 0.3, 0.6]
    like = lambda c: " * ".join(f"s.t[{(j * 2 + c) * 3} + 1 + p.v[{j}]]" for j in range(LABELERS))
    given = f"transform(pats, p -> struct(p.n as n, p.v as v, (s.pi * {like(1)}) / (s.pi * {like(1)} + (1 - s.pi) * {like(0)}) as q))"
    mass = lambda c, extra="": f"aggregate(ps, 0D, (a, p) -> a + p.n * {'p.q' if c else '(1 - p.q)'}{extra})"
    cells = ", ".join(f"(1 + {mass(c, f' * if(p.v[{j}] = {v}, 1, 0)')}) / (3 + {mass(c)})" for j in range(LABELERS) for c in (0, 1) for v in (-1, 0, 1))
    step = f"transform(array({given}), ps -> struct((1 + {mass(1)}) / (2 + {mass(1)} + {mass(0)}) as pi, array({cells}) as t))[0]"
    init = f"struct(0.5D as pi, array({', '.join(f'{x}D' for x in start)}) as t)"
    fit = counts.agg(F.collect_list(F.struct("n", F.array(*VOTES).alias("v"))).alias("pats")).select(F.expr(f"aggregate(sequence(1, {rounds}), {init}, (s, i) -> {step})").alias("m"))
    m = fit.first()["m"]
    return m["pi"], list(m["t"])


def posterior(pi: float, t: list[float], vote=F.col) -> Column:
    """The labelers' joint posterior of a candidate."""
    table = F.array(*map(F.lit, t))
    def like(c: int) -> Column:
        out = F.lit(pi if c else 1 - pi)
        for j in range(LABELERS):
            out = out * F.element_at(table, vote(f"v{j}") + (j * 2 + c) * 3 + 2)
        return out
    return like(1) / (like(1) + like(0))


def _features(of) -> Column:
    digits, size = of("n_digits").cast("string"), of("size").cast("string")
    return F.array(F.concat(F.lit("kind="), of("kind")), F.concat(F.lit("digits="), of("kind"), F.lit(":"), digits), F.concat(F.lit("size="), of("kind"), F.lit(":"), size), *[F.concat(F.lit(f"v{j}="), of(f"v{j}").cast("string")) for j in range(LABELERS)])


def fit(hits: DataFrame) -> dict[str, float] | None:
    """Weights of the span classifier by feature (``""``: the prior), from rows with an array ``hits``; null without any.

    Candidates become counts of feature tuples before the shuffle; labelers and classifier are fitted on that table."""
    names = ["kind", "n_digits", "size", *VOTES]
    tuples = staged(hits.select(F.explode("hits").alias("h")).select(*[F.col(f"h.{x}").alias(x) for x in names]).groupBy(*names).agg(F.count("*").alias("n")))
    pi, t = reliabilities(tuples)
    q = posterior(pi, t)
    # one row a feature value: fewer than 300 by construction
    sums = tuples.select((q * F.col("n")).alias("q"), "n", F.explode(_features(F.col)).alias("f")).groupBy("f").agg(F.sum("q").alias("yes"), F.sum(F.col("n") - F.col("q")).alias("no")).collect()
    discard(tuples)
    if not sums:
        return None
    yes, no = (sum(r[k] for r in sums if r["f"].startswith("kind=")) for k in ("yes", "no"))
    weight = {r["f"]: math.log((r["yes"] + 0.5) / (yes + 1)) - math.log((r["no"] + 0.5) / (no + 1)) for r in sums}
    return weight | {"": math.log((yes + 0.5) / (no + 0.5))}


def spans_of(hits: Column, weights: dict[str, float] | None, least: float = 0.5) -> Column:
    """Struct (base, added): sorted arrays of (k, start, end); k is the kind's place in KINDS. ``added`` are the spans
    that the classifier gives a probability of ``least`` and that meet no base span."""
    kind = F.array(*map(F.lit, KINDS))
    span = lambda h: F.struct(F.array_position(kind, h["kind"]).cast("int").alias("k"), h["start"].alias("start"), h["end"].alias("end"))
    less = lambda s: F.struct((s["k"] - 1).alias("k"), s["start"].alias("start"), s["end"].alias("end"))
    of = lambda which: F.sort_array(F.transform(F.transform(F.filter(hits, which), span), less))
    base = of(lambda h: h["valid"])
    if weights is None:
        return F.struct(base.alias("base"), F.slice(base, 1, 0).alias("added"))
    table = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])
    def likely(h: Column) -> Column:
        z = F.aggregate(_features(lambda name: h[name]), F.lit(weights[""]), lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
        return h["added"] & (1 / (1 + F.exp(-z)) >= least)
    def both(sure: Column) -> Column:
        clear = lambda s: ~F.exists(sure, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.struct(sure.alias("base"), F.filter(of(likely), clear).alias("added"))
    # base spans are made once a text, not once a candidate: they are the single element of an outer array
    return F.element_at(F.transform(F.array(base), both), 1)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, base, added) for each row: sorted arrays of (k, start, end); k is the kind's place in KINDS."""
    rows = staged(docs.select(F.col(id_col).alias("id"), hits_of(F.col(text_col)).alias("hits")))
    return rows.select("id", spans_of(F.col("hits"), fit(rows), least).alias("s")).select("id", "s.base", "s.added")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; same columns. Null text stays null.

    Texts are read twice, to fit and to replace, and neither written nor shuffled."""
    weights = fit(docs.select(hits_of(F.col(text_col)).alias("hits")))
    hits, spans = fresh(docs, "hits"), fresh(docs, "spans")
    order = lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    found = docs.withColumn(hits, hits_of(F.col(text_col))).withColumn(spans, spans_of(F.col(hits), weights))
    found = found.withColumn(spans, F.array_sort(F.concat(F.col(spans)["base"], F.col(spans)["added"]), order))
    text = F.col(text_col)
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<string>").alias("out"))
    def put(acc: Column, s: Column) -> Column:
        word = F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), F.lit(">"))
        new = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), word)).alias("out"))
        # a span that starts inside the one before only moves the end on
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["at"], inside).otherwise(new)
    def block(acc: Column, b: Column) -> Column:
        return F.aggregate(b, start(acc["at"]), put, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(x["out"], ""))).alias("out")))
    done = F.aggregate(_blocks(F.col(spans)), start(F.lit(0).cast("bigint")), block, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return found.withColumn(text_col, F.when(F.size(spans) > 0, done).otherwise(text)).select(*own_columns(docs))
