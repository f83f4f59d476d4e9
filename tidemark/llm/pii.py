"""Personal data (operator 1): weak supervision in DataFrame and SQL functions only.

Base kinds come from fixed patterns. Further candidates (local phone numbers, social security numbers, IBANs, secrets,
obfuscated addresses, named persons) come from wider patterns, and labelers vote on them: +1, 0 (abstain) or -1.
Labelers are regular expressions on the span, gazetteers, and cues in the context. Rows are counted by vote pattern, of
which there are at most |kinds| * 3^|labelers| whatever the input; expectation-maximisation over these counts
estimates each labeler's reliability, and its posteriors train the final span classifier, a naive Bayes model over
kind, votes and shape, which decides on each candidate. Base spans are kept whatever it says.

Patterns use possessive loops and start only where a run starts, so that one attempt is made per run: no text makes
them take more than linear time, and none makes them recurse. A text is cut at its matches once per kind; places are
running sums of the parts' lengths, taken over short stretches and then over these, since an accumulator that grows is
copied at every step. So the number of matches may be large too.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fresh, new_folder

BASE = ("email", "ip", "card", "phone")
EXTRA = ("person", "secret", "ssn", "iban", "local_phone", "obfuscated_email")
KINDS = (*BASE, *EXTRA)

_LOCAL = r"[A-Za-z0-9._%+-]"
_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Leftmost non-overlapping matches of these are those of the plain patterns in the docstring of find().
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "person": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?\x20\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20})?",
    "secret": r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{16,}+={0,2}+(?![A-Za-z0-9_/+=-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "obfuscated_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,4}+",
}
#: What a text must hold before a pattern is tried.
NEEDS = {
    "email": ("@",), "phone": ("+",), "person": ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor"), "obfuscated_email": ("at]", "at)", "AT]", "AT)"),
}

#: labeler -> kind -> pattern that the span (regex, gazetteer) or its context (left, right) must hold for a vote.
REGEX = {
    "secret": (r"^(?:(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}+|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_/+-]{24,}+={0,2}|(?:sk|pk|ghp|gho|xox[bp])[_-].*|AKIA[0-9A-Z]{16})$", r"^(?!AKIA)(?:[A-Za-z]+|[0-9]+|[a-z]++(?:[-/_][a-z]++)*+|.*(.)\1{5}.*)$"),
    "ssn": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^(?:000|666|9)|-00-|-0000$"),
    "iban": (r"^(?:AD|AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)", r"^(?:[A-Z]{2}0[01]|.*(.)\1{7})"),
    "local_phone": (r"^\(?[2-9][0-9]{2}\)?[\x20.-][2-9][0-9]{2}[\x20.-][0-9]{4}$", r"^\(?[01]"),
    "obfuscated_email": (r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|io|de|fr|es|uk)$", r"^[0-9]+"),
    "person": (r"\x20\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}+$", r"\x20\p{Lu}\p{Ll}$"),
}
FIRST_NAMES = """Adam Aisha Alan Albert Alejandro Alexander Alice Amanda Amelia Amy Ana Andrea Andrew Angela Anna Anne Anthony Antoine
Antonio Barbara Benjamin Bernd Brian Bruno Camille Carlos Carmen Carol Caroline Catherine Charles Charlotte Chloe Christian Christine
Claire Claudia Daniel David Deborah Diego Dieter Dirk Donald Dorothy Edward Elena Elizabeth Emily Emma Eric Fatima Fernando Francisco
Frank Gabriel George Hannah Hans Heike Helen Helga Henry Ines Ingrid Isabel Jack Jacques James Jane Javier Jean Jennifer Jessica Joan Johann
John Jonas Jorge Joseph José Juan Julia Julie Julien Jürgen Karen Karl Katherine Kevin Klaus Laura Lena Linda Lisa Louis Lucas Lucía Luis
Manuel Marcel María Margaret Maria Marie Mark Marta Martin Mary Matthew Max Michael Michel Miguel Monika Nancy Nathalie Nicolas Nicole Oliver Olivia
Otto Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Rachel Rafael Ralf Richard Robert Rosa Ruth Sandra Sarah Sofia Sophie Stefan Stephen
Susan Sylvie Teresa Thomas Uwe Victor Walter William Wolfgang Yves""".split()
SURNAMES = """Adams Allen Alonso Álvarez Anderson Andersen Baker Bauer Becker Bell Bernard Bertrand Bonnet Braun Brown Campbell Carter Castro Clark Collins
Cook Cooper Cruz Davis Delgado Díaz Dubois Dupont Durand Edwards Evans Fernández Fischer Fontaine Fournier Garcia García Gómez González Gray
Green Gutiérrez Hall Harris Hartmann Hernández Hill Hoffmann Hughes Jackson Jiménez Johnson Jones Kelly Khan King Klein Koch Köhler König Krause
Krüger Lambert Lange Laurent Lee Lefebvre Lehmann Leroy Lewis López Maier Martin Martínez Mayer Meyer Miller Mitchell Moore Morales Moreau Morel Moreno
Morgan Morris Müller Muñoz Murphy Navarro Nelson Neumann Ortiz Parker Patel Pérez Petit Phillips Ramírez Ramos Richter Rivera Robert Roberts Robinson
Rodríguez Rogers Romero Rousseau Roux Ruiz Sánchez Schäfer Schmidt Schmitt Schneider Scholz Schröder Schulz Schwarz Scott Silva Simon Smith
Stewart Suárez Taylor Thomas Thompson Torres Turner Vargas Vázquez Vincent Wagner Walker Ward Watson Weber Werner White Williams Wilson Wolf Wood Wright
Young Zimmermann""".split()
#: Total lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
#: Beginnings that issuers give their keys.
KEY_HEADS = "sk_live_ sk_test_ sk- pk_live_ pk_test_ rk_live_ ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xoxb- xoxp- xoxa- xoxs- AKIA ASIA AIza ya29 eyJ npm_ pypi- hf_ dop_v1_ shpat_ sq0csp- whsec_ AC00 key- SG".split()
PROVIDERS = "gmail googlemail yahoo outlook hotmail live icloud aol gmx web proton protonmail mail yandex zoho fastmail orange wanadoo free laposte telefonica example company university school bank".split()
AREA_CODES = """201 202 203 205 206 207 208 209 210 212 213 214 215 216 217 218 219 224 225 228 229 231 234 239 240 248 251 252 253 254 256 260 262 267 269 270
281 301 302 303 304 305 307 308 309 310 312 313 314 315 316 317 318 319 320 321 323 330 334 336 337 347 351 352 360 361 386 401 402 404 405 406 407 408 409 410
412 413 414 415 417 419 423 424 425 432 434 440 443 469 478 479 480 484 501 502 503 504 505 507 508 509 510 512 513 515 516 517 518 520 530 540 541 551 559 561""".split()


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


GAZETTEER = {
    "secret": rf"^{_any(KEY_HEADS)}", "ssn": r"(?!)",
    "iban": "^(?:" + "|".join(rf"{land}(?:\x20?[A-Z0-9]){{{n - 2}}}$" for land, n in IBAN_LENGTHS.items()) + ")",
    "local_phone": rf"^\(?{_any(AREA_CODES)}", "obfuscated_email": rf"(?i)[\])]\x20?{_any(PROVIDERS)}(?![A-Za-z0-9])",
    "person": rf"\x20(?:{_any(FIRST_NAMES)}|{_any(SURNAMES)})(?!\p{{L}})",
}
#: Numbers that were printed in advertisements or stand in examples; words that are no keys.
NOT_LISTED = {"ssn": r"^(?:078-05-1120|219-09-9999|123-45-6789|111-11-1111|457-55-5462)$", "local_phone": r"^\(?(?:123[\x20.)-]+456|[0-9]{3}\)?[\x20.-]000)", "secret": r"^(?:abcdef|0123456789|1234567890|x{8}|X{8})"}
LEFT = {
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api.?key|access.?key|auth|bearer|credential|private.?key)\P{L}{0,8}$",
    "ssn": r"(?i)(?:ssn|social security|soc sec|tax id)[^.]{0,24}$",
    "iban": r"(?i)(?:iban|account|konto|compte|cuenta|bank)[^.]{0,24}$",
    "local_phone": r"(?i)(?:call|phone|tel|mobile|cell|fax|contact|dial|ring)[^.]{0,24}$",
    "obfuscated_email": r"(?i)(?:mail|contact|write|reach|address)[^.]{0,24}$",
    "person": r"(?i)(?:dear|contact|patient|employee|client|attn|sincerely|by|from|with|name)\P{L}{0,3}$",
}
AGAINST = {
    "secret": r"(?i)(?:https?:|www\.|sha1|sha256|md5|digest|checksum|commit|/)[^ ]{0,40}$", "ssn": r"(?i)(?:isbn|part|order|invoice|no\.)[^.]{0,12}$", "iban": r"(?i)(?:isbn|part|serial|version)[^.]{0,12}$",
    "local_phone": r"(?i)(?:version|isbn|order|invoice|part|page)[^.]{0,12}$", "obfuscated_email": r"(?i)(?:meet|look)\P{L}{0,3}$", "person": r"(?i)(?:street|avenue|hotel)\P{L}{0,3}$",
}
RIGHT = {
    "secret": r"^[\"'`]", "ssn": r"^[\x20,.;]|^$", "iban": r"^[\x20,.;]|^$", "local_phone": r"^[\x20,.;)]|^$", "obfuscated_email": r"^[\x20,.;>)]|^$",
    "person": r"^(?:['’]s|,|\x20(?:said|wrote|was|is|lives|born))",
}
LABELERS = ("regex", "gazetteer", "left", "against", "right")
CONTEXT = 48


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^(?:{_BYTE}\.){{3}}{_BYTE}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _votes(kind: str, m: Column, left: Column, right: Column) -> Column:
    """Votes of LABELERS as a string of +, 0 and -."""
    yes, no = REGEX[kind]

    def vote(up: Column, down: Column | None = None) -> Column:
        out = F.when(up, "+")
        return (out.when(down, "-") if down is not None else out).otherwise("0")

    return F.concat(vote(m.rlike(yes) & ~m.rlike(no), m.rlike(no)), vote(m.rlike(GAZETTEER[kind]), m.rlike(NOT_LISTED[kind]) if kind in NOT_LISTED else None), vote(left.rlike(LEFT[kind])), F.when(left.rlike(AGAINST[kind]), "-").otherwise("0"), vote(right.rlike(RIGHT[kind])))


def _shape(m: Column) -> Column:
    """Length and share of digits, coarsely: at most 6 * 5 values."""
    n = F.char_length(m)
    digits = F.floor(4 * F.char_length(F.regexp_replace(m, "[^0-9]", "")) / n)
    return F.concat_ws("/", F.least(F.lit(5), F.floor(n / 8)).cast("string"), digits.cast("string"))


#: What is found: natural order is by start, then kind as listed. Base spans have no votes and no shape.
SPAN = "struct<start:int,k:int,stop:int,votes:string,shape:string>"
#: Items of a stretch: running sums copy what they have so far at every step.
STRETCH = 64


def _let(value: Column, body) -> Column:
    """body(value), the value being worked out once: an expression named in an inner function is else run every time."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, op) -> Column:
    """array<int> -> what op makes of the values before each place and, last, of all of them (0 before the first). op is
    associative. A stretch copies at most STRETCH numbers a step, the second level one number per stretch."""

    def few(own: Column) -> Column:
        return F.aggregate(own, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, op(F.element_at(acc, -1), x)))

    def joined(parts: Column, before: Column) -> Column:
        moved = F.transform(parts, lambda p, j: F.transform(F.slice(p, 1, F.size(p) - 1), lambda v: op(F.get(before, j), v)))
        return F.array_append(F.flatten(moved), F.element_at(before, -1))

    def whole(own: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(STRETCH))
        return _let(F.transform(first, lambda i: few(F.slice(own, i, STRETCH))), lambda parts: _let(few(F.transform(parts, lambda p: F.element_at(p, -1))), lambda before: joined(parts, before)))

    return _let(values, whole)


def _spans(text: Column, k: int, kind: str) -> Column:
    """array<SPAN> of a kind's matches that pass its test, code points, end exclusive; empty for a text without any.

    A candidate's context is what stands before and behind it, back over two matches of its kind at most and on to the
    next one."""
    # gaps and the match behind each; null behind the last
    pairs = F.zip_with(F.split(text, PATTERNS[kind], -1), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def said(own: Column, i: Column) -> Column:
        return F.coalesce(F.concat(F.get(own, i)["g"], F.get(own, i)["m"]), F.lit(""))

    def items(own: Column, at: Column) -> Column:
        def item(x: Column, i: Column) -> Column:
            start = F.get(at, i) + F.char_length(x["g"])
            left = F.right(F.concat(said(own, i - 2), said(own, i - 1), x["g"]), F.lit(CONTEXT))
            votes = F.lit(None) if kind in BASE else _votes(kind, x["m"], left, F.substring(F.get(own, i + 1)["g"], 1, 12))
            shape = F.lit(None) if kind in BASE else _shape(x["m"])
            made = F.struct(start.alias("start"), F.lit(k).alias("k"), (start + F.char_length(x["m"])).alias("stop"), votes.cast("string").alias("votes"), shape.cast("string").alias("shape"))
            return F.when(x["m"].isNotNull() & _valid(kind, x["m"]), made)

        return F.filter(F.transform(own, item), lambda x: x.isNotNull())

    def found(own: Column) -> Column:
        lengths = F.transform(own, lambda x: F.char_length(x["g"]) + F.coalesce(F.char_length(x["m"]), F.lit(0)))
        return _let(_running(lengths, lambda a, b: a + b), lambda at: items(own, at))

    if kind in NEEDS:
        gate = F.lit(False)
        for word in NEEDS[kind]:
            gate = gate | F.contains(text, F.lit(word))
    else:
        gate = text.rlike("[0-9]|AKIA" if kind == "secret" else "[0-9]")
    return F.when(gate & text.rlike(PATTERNS[kind]), _let(pairs, found).cast(f"array<{SPAN}>")).otherwise(F.expr(f"CAST(array() AS array<{SPAN}>)"))


def _free(spans: Column) -> Column:
    """Sorted spans without the candidates that lie inside a base span: such a base span stands before them, and the
    farthest end of those before tells."""
    ends = lambda own: _running(F.transform(own, lambda x: F.when(x["k"] < len(BASE), x["stop"]).otherwise(F.lit(0))), F.greatest)
    kept = lambda own, end: F.filter(own, lambda x, i: (x["k"] < len(BASE)) | (F.get(end, i) < x["stop"]))
    return _let(spans, lambda own: _let(ends(own), lambda end: kept(own, end)))


def candidates(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with column `out`: base spans and candidates of every text, array<SPAN>, sorted; k is a kind's place in KINDS.
    Candidates that lie inside a base span are left out."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    found = F.sort_array(F.concat(*(_spans(t, k, kind) for k, kind in enumerate(KINDS))))
    some = lambda own: F.when(F.exists(own, lambda x: x["k"] >= len(BASE)), _free(own)).otherwise(own)
    return docs.withColumn(out, _let(found, some))


#: First guess of how often a labeler's vote is right; it counts as much as GUESS candidates, whatever the corpus. Every
#: labeler is taken to be better than chance, and none to be beyond doubt.
RIGHT_AT_FIRST, GUESS, WORST, BEST = 0.8, 20.0, 0.6, 0.99
#: What is taken to be the probability that a candidate is personal data for which and against which no labeler votes.
UNSAID = 0.05


def estimate(votes: dict[tuple[int, str], float], rounds: int = 60) -> tuple[dict[tuple[int, str], float], list[float]]:
    """Expectation-maximisation over counts of (kind, votes): the probability that each is personal data, and how often
    each labeler's votes are right. Each kind has a share of its own.

    Abstaining says nothing: where a corpus holds hardly any false candidates, the two classes would else come to stand
    for two sorts of true ones, those with a cue and those without."""
    prior = {k: 0.5 for k, _ in votes}
    right = [RIGHT_AT_FIRST] * len(LABELERS)
    said = [q for q in votes if q[1].strip("0")]
    truth = dict.fromkeys(votes, UNSAID)
    for _ in range(rounds):
        for k, pattern in said:
            odds = math.log(prior[k] / (1 - prior[k])) + sum((v == "+" or -1) * math.log(right[j] / (1 - right[j])) for j, v in enumerate(pattern) if v != "0")
            truth[k, pattern] = 1 / (1 + math.exp(-odds))
        for k in prior:
            mine = [q for q in said if q[0] == k]
            prior[k] = (0.5 * GUESS + sum(votes[q] * truth[q] for q in mine)) / (GUESS + sum(votes[q] for q in mine))
        for j in range(len(LABELERS)):
            mine = [q for q in said if q[1][j] != "0"]
            good = sum(votes[q] * (truth[q] if q[1][j] == "+" else 1 - truth[q]) for q in mine)
            right[j] = min(BEST, max(WORST, (RIGHT_AT_FIRST * GUESS + good) / (GUESS + sum(votes[q] for q in mine))))
    return truth, right


def learn(found: DataFrame, spans: str) -> dict[str, float]:
    """Weights of the span classifier's features (with "bias"), from the rows of candidates().

    All arithmetic is over the counts of vote patterns and shapes, at most 6 * 3^5 * 30 rows for any input."""
    extra = F.filter(spans, lambda x: x["k"] >= len(BASE))
    rows = found.select(F.explode(extra).alias("x")).groupBy("x.k", "x.votes", "x.shape").count().collect()
    return classifier([(r["k"], r["votes"], r["shape"], r["count"]) for r in rows])


def classifier(rows: list[tuple[int, str, str, float]]) -> dict[str, float]:
    """Naive Bayes over kind, votes and shape, trained on the estimated truth of counted (kind, votes, shape)."""
    votes: dict[tuple[int, str], float] = defaultdict(float)
    for k, pattern, _, n in rows:
        votes[k, pattern] += n
    truth, _ = estimate(votes)
    mass = {True: defaultdict(float), False: defaultdict(float)}
    size = {True: 1.0, False: 1.0}
    for k, pattern, shape, n in rows:
        p = truth[k, pattern]
        for side, share in ((True, p), (False, 1 - p)):
            size[side] += n * share
            for f in features(k, pattern, shape):
                mass[side][f] += n * share
    seen = sorted({*mass[True], *mass[False]})
    ratio = lambda f: math.log((mass[True][f] + 0.5) / (size[True] + 1)) - math.log((mass[False][f] + 0.5) / (size[False] + 1))
    return {f: ratio(f) for f in seen} | {"bias": math.log(size[True] / size[False])}


def features(k: int, votes: str, shape: str) -> list[str]:
    """Names of a candidate's features: its kind, its shape among those of its kind, how many labelers speak for it, and
    each labeler's vote."""
    return [f"k{k}", f"s{k}/{shape}", f"p{votes.count('+')}", *(f"{j}{v}" for j, v in enumerate(votes))]


def accepted(spans: str, weights: dict[str, float]) -> Column:
    """The base spans, and those candidates that the classifier takes for personal data."""
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    get = lambda f: F.coalesce(F.element_at(table, f), F.lit(0.0))

    def score(x: Column) -> Column:
        kind = x["k"].cast("string")
        out = F.lit(weights["bias"]) + get(F.concat(F.lit("k"), kind)) + get(F.concat(F.lit("s"), kind, F.lit("/"), x["shape"]))
        out = out + get(F.concat(F.lit("p"), F.length(F.translate(x["votes"], "0-", "")).cast("string")))
        for j in range(len(LABELERS)):
            out = out + get(F.concat(F.lit(str(j)), F.substring(x["votes"], j + 1, 1)))
        return out

    return F.filter(spans, lambda x: (x["k"] < len(BASE)) | F.coalesce(score(x) > 0, F.lit(False)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _count(k: int, kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["k"] == k)).cast("long").alias(f"n_{kind}")


def find(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    Base kinds, leftmost non-overlapping each: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+; ip four runs of
    digits with dots between, none above 255; card [0-9]([ -]?[0-9])+ with 12 to 19 digits that pass Luhn; phone
    \\+[0-9][ ().0-9-]+[0-9] with 9 to 15 digits. A match that fails its test is dropped without another try.
    base_sha256 is the SHA-256 of the base spans as kind:start:end, comma-joined; spans has the method's too. A null
    text is empty: zeros, the digest of nothing, no spans. Repeated rows and null ids stay; other columns are ignored;
    an empty table gives no rows.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = cut(candidates(own, "text", "found").select("doc_id", "found"))
    base = F.filter("found", lambda s: s["k"] < len(BASE))
    counts = [_count(k, kind) for k, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(accepted("found", learn(found, "found"))).alias("spans"))


#: Code points of the blocks that a text is cut into before parts of it are taken: finding a place in a UTF-8 string takes
#: time in proportion to the place.
BLOCK = 4096


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span in `text` replaced by its kind in brackets; overlapping spans count as one, of the first
    one's kind. Null texts and texts without spans stay as they are, as do all other columns, whatever their names, null
    ids and repeated rows; an empty table gives no rows. Rows and spans are written to the shared folder once: the
    classifier is learned from all of them before the first text is changed."""
    spark = docs.sparkSession
    (spans,) = fresh(docs.columns, "spans")
    folder = new_folder(spark, "spans")
    candidates(docs, text, spans).write.parquet(folder)
    found = spark.read.parquet(folder)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    t = F.col(text).cast("string")

    def between(blocks: Column, a: Column, b: Column) -> Column:
        """Code points [a, b) of the text, from its blocks."""

        def part(block: Column, j: Column) -> Column:
            before = (F.floor(a / BLOCK).cast("int") + j) * BLOCK
            low = F.greatest(a - before, F.lit(0))
            return F.substring(block, low + 1, F.least(b - before, F.lit(BLOCK)) - low)

        first = F.floor(a / BLOCK).cast("int")
        return F.array_join(F.transform(F.slice(blocks, first + 1, F.floor(b / BLOCK).cast("int") - first + 1), part), "")

    def replaced(own: Column, end: Column, blocks: Column) -> Column:
        """end: the farthest end of the spans before each, and of all."""
        parts = F.transform(own, lambda s, i: F.when(s["start"] >= F.get(end, i), F.concat(between(blocks, F.get(end, i), s["start"]), F.element_at(names, s["k"] + 1))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), between(blocks, F.element_at(end, -1), F.size(blocks) * BLOCK))

    blocks = F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    ends = lambda own: _running(F.transform(own, lambda s: s["stop"]), F.greatest)
    cleaned = lambda own: _let(ends(own), lambda end: _let(blocks, lambda cut_up: replaced(own, end, cut_up)))
    taken = accepted(spans, learn(found.select(spans), spans))
    return found.withColumn(text, _let(taken, lambda own: F.when(F.size(own) > 0, cleaned(own)).otherwise(t))).select(*docs.columns)
