"""Secrets of any length; candidates that hold a base span."""

import random

from tidemark.llm import pii

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.spans for r in pii.find(df).collect()}, {r.doc_id: r.text for r in pii.redact(df).collect()}


def test_long_secrets(spark):
    rng = random.Random(3)
    token = lambda n: "".join(rng.choice(LETTERS) for _ in range(n - 3)) + "aZ7"
    long = [token(n) for n in (128, 129, 200, 300, 5000)]
    texts = [f"session_token={x} ok" for x in long] + [f"see {x} ok" for x in long]
    # words and hyphens without end, plain repetition: no secrets, and nothing that takes the stack
    clean = ["see " + "plain-words-" * 3000 + "end ok", "see " + "ab" * 20_000 + " ok", "see " + "7" * 20_000 + " ok", "a clean text"]
    spans, redacted = found(spark, texts + clean)
    for k, x in enumerate(long):
        assert spans[k] == f"secret:14:{14 + len(x)}" and redacted[k] == "session_token=[SECRET] ok"
        assert spans[len(long) + k] == f"secret:4:{4 + len(x)}" and redacted[len(long) + k] == "see [SECRET] ok"
    assert all(not spans[len(texts) + k] for k in range(len(clean)))


def test_ibans_that_hold_a_card(spark):
    numbers = ["4111111111111111", "5500005555555559"]  # pass Luhn
    texts = [f"iban: {land}{tail} ok" for land in ("CH93", "AT61", "FI21", "BE68") for tail in (f" {n[:4]} {n[4:8]} {n[8:12]} {n[12:]}" for n in numbers)]
    texts += [f"iban: GB29 NWBK {n[:4]} {n[4:8]} {n[8:12]} {n[12:]} ok" for n in numbers]
    spans, redacted = found(spark, texts)
    for k, t in enumerate(texts):
        assert f"iban:6:{len(t) - 3}" in spans[k].split(","), (t, spans[k])
        assert redacted[k] == "iban: [IBAN] ok"
    held = [k for k in spans if "card:" in spans[k]]
    assert held
    # what lies inside a base span is none
    spans, redacted = found(spark, ["write to a-very-long-local-part-1234@example.com", "+1 415 555-0132"])
    assert spans[0].startswith("email:") and "," not in spans[0] and spans[1].startswith("phone:") and "," not in spans[1]


def test_estimation_finds_the_labelers_reliabilities():
    """Votes drawn from known reliabilities: they are found again, whatever the number of candidates."""
    rng = random.Random(5)
    speaks, says = (0.9, 0.5, 0.6, 0.5, 0.4), (0.95, 0.9, 0.85, 0.8, 0.7)
    share = {4: 0.8, 5: 0.3, 6: 0.5}
    votes, right = {}, {}
    for _ in range(30_000):
        k = rng.choice((4, 5, 6))
        true = rng.random() < share[k]
        pattern = "".join("0" if rng.random() > p else "-+"[true == (rng.random() < s)] for p, s in zip(speaks, says, strict=True))
        votes[k, pattern] = votes.get((k, pattern), 0) + 1
        right[k, pattern] = right.get((k, pattern), 0) + true
    for times in (1, 1000):
        truth, found = pii.estimate({q: n * times for q, n in votes.items()})
        assert all(abs(f - s) < 0.03 for f, s in zip(found, says, strict=True)), found
        said = [q for q in votes if q[1].strip("0")]
        assert sum(abs(truth[q] - right[q] / votes[q]) * votes[q] for q in said) / sum(votes[q] for q in said) < 0.03


def test_classes_are_not_two_sorts_of_true_candidates():
    """Where nearly every candidate is true and only the cues differ."""
    votes = {(5, "+0000"): 4000.0, (5, "+0+00"): 3000.0, (5, "+0+0+"): 3000.0, (5, "-0000"): 20.0, (5, "00000"): 5.0}
    truth, found = pii.estimate(votes)
    assert all(truth[q] > 0.5 for q in votes if "+" in q[1]) and truth[5, "00000"] == pii.UNSAID
    weights = pii.classifier([(k, v, "4/2", n) for (k, v), n in votes.items()])
    score = lambda v: weights["bias"] + sum(weights.get(f, 0) for f in pii.features(5, v, "4/2"))
    assert all(score(v) > 0 for v in ("+0000", "+0+00", "+0+0+")) and score("00000") < 0


def fixture(rng):
    """(text, kind, whether the candidate in it is personal data) of made-up sentences."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a7"
    first, last = rng.choice(pii.FIRST_NAMES), rng.choice(pii.SURNAMES)
    return [
        (f'{rng.choice(("token", "password", "api key", "secret"))} = "{hexa(rng.randrange(32, 60))}"', "secret", True),
        (f"pay {rng.choice(pii.KEY_HEADS[:8])}{hexa(30)} here", "secret", True),
        (f"see {'abcdefghij' * 2}{rng.choice('klmn')} there", "secret", False),
        (f"number {digits(rng.randrange(20, 30))} of it", "secret", False),
        (f"social security {rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}, ok", "ssn", True),
        (f"part no. 9{digits(2)}-00-{digits(4)}x or 000-{rng.randrange(10, 99)}-{digits(4)}", "ssn", False),
        (f"iban: DE{rng.randrange(10, 99)}{digits(18)}, thanks", "iban", True),
        (f"serial QX00{digits(16)}; next", "iban", False),
        (f"call {rng.choice(pii.AREA_CODES)} {rng.randrange(200, 999)}-{digits(4)}, please", "local_phone", True),
        (f"invoice 1{digits(2)} {digits(3)} {digits(4)} due", "local_phone", False),
        (f"contact {first.lower()} [at] {rng.choice(('gmail', 'example'))} [dot] com.", "obfuscated_email", True),
        (f"dear Mr {first} {last}, hello", "person", True),
    ]


def test_classifier_on_held_out_sentences(spark):
    """Trained on one half without any label; judged on candidates of the other half."""
    rng = random.Random(12)
    train, test = ([x for _ in range(60) for x in fixture(rng)] for _ in range(2))
    frame = lambda rows: pii.candidates(spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "doc_id long, text string"), "text", "found")
    weights = pii.learn(frame(train), "found")
    got = {r.doc_id: {pii.KINDS[x.k] for x in r.taken} for r in frame(test).select("doc_id", pii.accepted("found", weights).alias("taken")).collect()}
    right: dict = {}
    for k, (_, kind, true) in enumerate(test):
        right.setdefault((kind, true), []).append((kind in got[k]) == true)
    shares = {q: sum(v) / len(v) for q, v in right.items()}
    assert all(v >= 0.8 for v in shares.values()) and sum(shares.values()) / len(shares) >= 0.93, str(shares)


def test_very_many_matches_in_one_text(spark):
    """200,000 numbers, and tens of thousands of spans that are kept: work in proportion, nothing lost."""
    rng = random.Random(2)
    numbers = ", ".join(str(rng.randrange(10**6)) for _ in range(200_000))
    many = ", ".join(f"u{k}@x.org" for k in range(30_000)) + ", " + ", ".join(f"{rng.randrange(100, 600)}-{rng.randrange(10, 99)}-{rng.randrange(1000, 9999)}" for _ in range(30_000))
    rows = spark.createDataFrame([(1, numbers), (2, many)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    assert got[1].spans == "" and got[2].n_email == 30_000 and got[2].spans.count("ssn:") == 30_000
    ends = [tuple(map(int, s.split(":")[1:])) for s in got[2].spans.split(",")]
    assert all(a < b <= c for (a, b), (c, _) in zip(ends, ends[1:], strict=False)) and ends[-1][1] == len(many)
    clean = {r.doc_id: r.text for r in pii.redact(rows).collect()}
    assert clean[1] == numbers and clean[2] == ", ".join(["[EMAIL]"] * 30_000 + ["[SSN]"] * 30_000)
