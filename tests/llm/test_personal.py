from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from souk.llm import personal

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn_holds(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The contract by Python's regular expressions."""
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn_holds(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def found_in(spark, texts, **how):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __spans string")
    out = personal.find_personal(df, **how)
    assert out.columns == ["doc_id", "text", "__spans"]
    return {r["doc_id"]: [tuple(x) for x in r["__spans"]] for r in out.collect()}


PIECES = ["a", "b.c", "@", ".", "-", " ", "+", "(", ")", "1", "25", "255", "256", "007", "4111 1111 1111 1111", "\n", "é", "😀",
          "x_y@mail.example.com", "10.0.0.1", "4012888888881881", "+49 30 1234567", "+1 (555) 010-9999", "%", "_"]


def test_base_kinds_as_their_patterns_say(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += [None, "", "@", "a@b", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1.2.3", "300.1.1.1 1.300.1.1", "+1+1234567890", "+1(((((((9"]
    got = found_in(spark, texts)
    for i, text in enumerate(texts):
        assert [x[:3] for x in got[i] if x[0] in BASE] == base_spans(text or ""), text


def test_very_long_texts(spark):
    many = " ".join(f"mail{i}@host.example.com 10.0.{i % 300}.1 é" for i in range(20_000))
    runs = ["a" * 400_000 + "@", "1" * 400_000, "1-" * 200_000, "x@" + "a." * 100_000 + "b", "+1" + "(" * 300_000,
            "1." * 150_000, "A" * 100_000 + "B2" * 100_000]
    got = found_in(spark, [many, *runs])
    assert [x[:3] for x in got[0] if x[0] in BASE] == base_spans(many)
    # Python's search needs quadratic time for most of these: what is in them is written down.
    assert [[x[:3] for x in got[i + 1] if x[0] in BASE] for i in range(len(runs))] == [
        [], [], [], [("email", 0, len(runs[3]))], [], [("ip", i * 8, i * 8 + 7) for i in range(37_500)], []]


ADDED = [
    ("IBAN DE89 3704 0044 0532 0130 00 for rent", ["iban"]),
    ("GB29NWBK60161331926819", ["iban"]),
    ("GB28NWBK60161331926819", []),                       # fails by 97
    ("her ssn is 219-09-9999", ["ssn"]),
    ("part 219-09-9999 of the order", []),                # context speaks against it
    ("social security 000-09-9999, 666-12-3456, 900-12-3456, 219-00-9999, 219-09-0000", []),
    ("born on 12.03.1984 in Rome", ["birth"]),
    ("geboren 1984-03-12", ["birth"]),
    ("shipped 12.03.1984", []),
    ("born 32.13.1984", []),
]


def test_added_kinds(spark):
    got = found_in(spark, [text for text, _ in ADDED])
    for i, (text, kinds) in enumerate(ADDED):
        assert [x[0] for x in got[i] if x[0] not in BASE] == kinds, text
        assert all(text[x[1]:x[2]] == x[3] for x in got[i])


def test_context_moves_the_score_but_not_base_spans(spark):
    got = found_in(spark, ["card 4111111111111111", "4111111111111111", "order 4111111111111111"])
    assert [got[i][0][4] for i in range(3)] == [100, 80, 40]


def test_repeated_rows_empty_table_and_redaction(spark):
    df = spark.createDataFrame([(None, "write to a@b.cd or 10.0.0.1!", 1)] * 2 + [(None, None, 1)],
                               "doc_id long, text string, n long")
    out = personal.find_personal(df).withColumn("clean", personal.redacted(F.col("text"), F.col("__spans")))
    assert sorted(r["clean"] for r in out.collect()) == ["", *["write to [EMAIL] or [IP]!"] * 2]
    assert personal.find_personal(df.limit(0)).count() == 0
    overlap = "ssn 219-09-9999 born 1984-03-12 +1 1984-03-12 777 5555"
    out = personal.find_personal(spark.createDataFrame([(overlap,)], "text string"))
    text = out.select(personal.redacted(F.col("text"), F.col("__spans")).alias("c")).first()["c"]
    assert "1984" not in text.split("born")[1].split("+")[0] and "[SSN]" in text


def test_no_python_in_the_plan(spark):
    plan = personal.find_personal(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
