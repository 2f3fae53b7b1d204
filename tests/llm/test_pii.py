"""Personal data: base spans against the contract's patterns, and the bootstrapping."""

import hashlib
import random
import re

import pytest

from packtables.llm import pii as P


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    t, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out)), [sum(x[1] == k for x in out) for k in range(4)]


def texts():
    rng = random.Random(6)
    parts = ["a", "B.c", "_", "@", ".", "x-y", "com", "1", "255", "256", "007", "4111111111111111", "4111 1111 1111 1111", "4111-1111", " ", " ",
             "+1 (555) 555-0100", "+", "(", "- ", "\n", "é", "🙂", "10.0.0.1", "%", "ann@mail.example.com", "+44 20 7946 0958", "12"]
    out = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(1200)]
    out += [None, "", "no data", "a@b.c_d@e.f", "a@b@c.de", "1.2.3.4.5.6.7.8", "99999999999999999999.1.1.1", "9" * 50_000, "1 " * 20_000,
            "x" * 50_000 + "@a.b", "+1" + " 1" * 9_000, "a." * 20_000, "00000000255.1.1.1", "1-" * 9000 + "5"]
    return out


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t, "c") for i, t in enumerate(texts())] + [(2, texts()[2], "c"), (None, "mail ann@x.org", "c")]
    df = spark.createDataFrame(data, "doc_id long, text string, uid string").repartition(4)
    return data, P.extract(df).collect(), df


def test_base_spans_match_the_patterns(rows):
    data, got, _ = rows
    want = sorted(((d, *brute(t)[1], hashlib.sha256(brute(t)[0].encode()).hexdigest()) for d, t, _ in data), key=str)
    assert sorted((tuple(r)[:6] for r in got), key=str) == want
    for r in got:
        kept = [x for x in r.spans.split(",") if x and not x.startswith("found_")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r.base_sha256


def test_empty_table(rows):
    assert P.extract(rows[2].limit(0)).collect() == []


def test_patterns_discover_unseen_identifiers(spark):
    """Seeds teach 'my card number'; a number that fails Luhn is found there, but not in clean text."""
    seeds = [f"please charge {c} today thanks" for c in ("4111111111111111", "5500005555555559", "340000000000009", "6011000000000004",
                                                         "4012888888881881", "378282246310005", "5105105105105100", "4222222222222")]
    docs = seeds + ["please charge 4111111111111112 today thanks", "the year 2024001 was long", "part 884412x is here", "nothing here"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in P.extract(df).collect()}
    assert got[8].spans == "found_card:14:30" and got[8].n_card == 0 and got[8].n_found == 1
    assert all(got[i].n_found == 0 for i in got if i != 8)
    assert all(got[i].spans.startswith("card:14:") for i in range(8))


def test_second_round_uses_what_the_first_found(spark):
    """Context A is taught by seeds; numbers found there teach context B, which finds another one."""
    cards = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "4012888888881881", "378282246310005",
             "5105105105105100", "4222222222222", "3566002020360505", "30569309025904", "38520000023237", "4242424242424242"]
    ids = [f"77{i}88123" for i in range(12)]
    docs = [f"please charge {c} today thanks" for c in cards] + [f"please charge {x} today thanks" for x in ids[:1]]
    docs += [f"we bill account {x} monthly now" for x in [*cards[:11], ids[0], ids[1]]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = lambda n: {r.value for r in P.bootstrap(*parts(df), rounds=n).collect()}
    assert ids[0] in found(1) and found(1) <= found(2)


def parts(df):
    spans = P.located(P.raw_matches(df)).cache()
    return spans.filter("kind <> 'token'"), P.clear_candidates(spans)


def test_candidates_overlapping_base_spans_are_left_out(spark):
    text = "a ann.123456@mail.example.com b 10.20.30.40 c abc123456 +1 (555) 555-0100 d"
    _, clear = parts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [r.value for r in clear.collect()] == ["abc123456"]


def test_native_plan(spark):
    plan = P.extract(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


CARDS = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004", "4012888888881881", "378282246310005",
         "5105105105105100", "4222222222222", "3566002020360505", "30569309025904", "38520000023237", "4242424242424242"]


def found_values(spark, docs):
    """The texts of the found spans, by their kind."""
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return [(x.split(":")[0], docs[r.doc_id][int(x.split(":")[1]):int(x.split(":")[2])])
            for r in P.extract(df).collect() for x in r.spans.split(",") if x.startswith("found_")]


def test_more_unseen_values_than_seeds(spark):
    unseen = [f"77{i:03}88123" for i in range(3 * len(CARDS))]
    docs = [f"please charge {c} today thanks" for c in CARDS + unseen] + ["in the year 2024001 it was", "the part 884412x is here"]
    assert sorted(found_values(spark, docs)) == [("found_card", x) for x in unseen]


def test_a_pattern_of_another_kind_as_well_is_not_trusted(spark):
    docs = [f"please note {c} today thanks" for c in CARDS[:8]] + [f"please note 10.1.2.{i} today thanks" for i in range(8)]
    assert found_values(spark, [*docs, "please note 7700088123 today thanks"]) == []


def test_a_chain_of_contexts_is_followed_to_its_end(spark):
    """Each context but the first is taught by what was found in the one before."""
    ids = [f"77{i:03}88123" for i in range(45)]
    docs = [f"please charge {x} today thanks" for x in CARDS + ids[:12]]
    for k, (a, b) in enumerate((("we bill account", "monthly now"), ("she paid using", "last week"), ("refund goes onto", "very soon"))):
        docs += [f"{a} {x} {b}" for x in ids[12 * k:12 * k + 23 if k < 2 else 45]]
    assert {x for _, x in found_values(spark, docs)} == set(ids)


def test_candidates_have_the_shapes_of_all_kinds(spark):
    """Groups and addresses that fail the base patterns are found whole where seeds of their kind stand."""
    spaced = [f"{c[:4]} {c[4:8]} {c[8:12]} {c[12:]}" for c in CARDS if len(c) == 16]
    phones = [f"+1 (555) 555-01{i:02}" for i in range(10)]
    mails = [f"user{i}@mail.example.com" for i in range(10)]
    docs = [f"please charge {x} today thanks" for x in [*spaced, "4111 1111 1111 1112"]]
    docs += [f"just call me {x} after lunch" for x in [*phones, "020 7946 0958", "(555) 010-4477", "5550104477", "555.010.4478."]]
    docs += [f"send mail to {x} for details" for x in [*mails, "ann.lee@localhost", "ann at example dot com", "bo[at]example[dot]com"]]
    docs += ["meet at the gate in 2024 or call 12", "look at example dot com"]
    want = {"found_card": ["4111 1111 1111 1112"], "found_phone": ["020 7946 0958", "(555) 010-4477", "5550104477", "555.010.4478"],
            "found_email": ["ann.lee@localhost", "ann at example dot com", "bo[at]example[dot]com"]}
    assert sorted(found_values(spark, docs)) == sorted((k, x) for k, v in want.items() for x in v)


def test_candidates_of_long_runs(spark):
    docs = ["1 " * 50_000 + "x", "(" * 20_000 + "1", "1 (" * 20_000, "a at " * 20_000, "1-" * 30_000 + "a", "9" * 100_000, "x." * 30_000 + "1",
            "a@" * 20_000, "%" * 50_000, "ann dot " * 20_000]
    assert found_values(spark, docs) == []
