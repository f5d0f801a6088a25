"""Top-k search, source mixing and pseudonyms."""

import datetime
import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolith.llm.mixing import DIMENSIONS, TEMPER, mix_sources, rake
from chronolith.llm.pii import ROUNDS, pseudonymise
from chronolith.llm.topk import exact_top_k


def plain_top(rows, k=10):
    end = 2**63 - 1
    whole = [(n, i, [math.floor(1024 * Fraction(float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    out = []
    for n, q, a in whole:
        if q % 100 == 0:
            scored = sorted((-max(-end, min(end, sum(x * y for x, y in zip(a, b)))), i) for m, i, b in whole if m != n and len(a) == len(b))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found_top(table, **options):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_top_k(table, **options).collect())


@pytest.mark.parametrize("dims,big", [(64, 1.0), (7, 1.0), (40, 1e5), (18, 1e8)])
def test_top_k_against_brute_force(spark, dims, big):
    rng = np.random.default_rng(dims)
    vectors = (rng.normal(size=(700, dims)) * big).astype(np.float32)
    vectors[3] = vectors[100]
    vectors[5:30] = vectors[200]  # ties
    rows = [(i * 4, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(100_001, None), (100_100, [None] * dims), (100_200, [float("nan")] * dims), (100_300, [float("inf")] * dims), (None, [1.0] * dims), (100_400, [1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    assert found_top(table) == plain_top(rows)


def test_top_k_in_many_waves_and_from_seeds(spark):
    rng = np.random.default_rng(8)
    rows = [(i * 20, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 33)).astype(np.float32))]
    rows += [rows[10], rows[15]]  # rows that share an id, one a query
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    expected = plain_top(rows)
    for options in ({"wave_bytes": 8 * 33 * 8}, {"seed_rows": 60}, {"wave_bytes": 8 * 33 * 30, "seed_rows": 3}):
        assert found_top(table, **options) == expected


def test_top_k_of_very_large_components(spark):
    rng = np.random.default_rng(9)
    rows = [(i * 50, v.tolist()) for i, v in enumerate((rng.normal(size=(60, 20)) * 1e30).astype(np.float32))]
    rows += [(i * 50 + 1, v.tolist()) for i, v in enumerate((rng.normal(size=(60, 20)) * 1e-30).astype(np.float32))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert found_top(table) == plain_top(rows)


def test_top_k_of_few_or_no_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_top_k(table).collect()] == [(0, 1, 1, 1024 * 1024)]
    assert exact_top_k(table.limit(0)).count() == 0


def mixed_documents(spark):
    rows = []
    for i in range(3000):
        source = "hot" if i % 3 == 0 else f"s{i % 7}"
        rows.append((i, f"w{i % 11} " * (1 + i % 40), ["en", "fr", None][i % 5 % 3], source, "x"))
    rows += [(5000, None, "en", "hot", "x"), (5001, "", None, None, "x"), (1, "again and again", "en", "hot", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, probability string")


def test_mixing_keeps_rows_and_meets_its_budget(spark):
    docs = mixed_documents(spark)
    rows = mix_sources(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.probability <= 1 for r in rows)
    total = sum(r.mix_tokens for r in rows)
    assert abs(sum(r.mix_tokens * r.probability for r in rows) / total - 0.6) < 0.01
    assert abs(sum(r.mix_tokens for r in rows if r.sampled) / total - 0.6) < 0.05
    again = {(r.doc_id, r.mix_tokens): r.sampled for r in mix_sources(docs.repartition(7)).collect()}
    assert all(again[r.doc_id, r.mix_tokens] == r.sampled for r in rows)
    assert mix_sources(docs.limit(0)).count() == 0


def plain_rake(cells, wanted, budget):
    """Bounded fitting in plain Python: the scale of a value is found by halving."""
    raw = {c: t * budget for c, t in cells.items()}
    for _ in range(400):
        for d in range(3):
            for value, want in wanted[d].items():
                part = [c for c in cells if c[d] == value]
                low, high = 0.0, 1e9
                for _ in range(80):
                    middle = (low + high) / 2
                    low, high = (middle, high) if sum(min(cells[c], middle * raw[c]) for c in part) < want else (low, middle)
                for c in part:
                    raw[c] *= high
    return {c: min(1.0, raw[c] / t) for c, t in cells.items()}


def raked(spark, cells, **options):
    table = spark.createDataFrame([(*c, t) for c, t in cells.items()], "mix_source string, mix_lang string, mix_topic string, tokens long")
    frame, miss = rake(table, **options)
    return {(r.mix_source, r.mix_lang, r.mix_topic): r for r in frame.collect()}, miss


def test_raked_marginals(spark):
    rng = np.random.default_rng(1)
    cells = {(f"s{a}", f"l{b}", f"t{c}"): int(rng.integers(50, 5000)) for a in range(5) for b in range(3) for c in range(4)}
    rows, miss = raked(spark, cells, budget_share=0.3)
    total = sum(cells.values())
    assert miss <= 1e-6
    for i, d in enumerate(DIMENSIONS):
        share: dict = {}
        got: dict = {}
        for c, r in rows.items():
            share[c[i]] = share.get(c[i], 0) + r.tokens / total
            got[c[i]] = got.get(c[i], 0) + r.expected / (0.3 * total)
        target = {k: v ** TEMPER[d] for k, v in share.items()}
        for k in share:
            assert abs(got[k] - target[k] / sum(target.values())) < 2e-6


def test_full_cells_are_made_up_within_their_values(spark):
    """Cells of graded sizes, targets that fill the small ones: the budget and every marginal still hold."""
    cells = {(f"s{a}", f"l{b}", f"t{c}"): 10 ** (1 + a) * (1 + b) * (2 + c) for a in range(4) for b in range(2) for c in range(3)}
    targets = {"source": {"s3": 0.93, "s2": 0.06}, "lang": {"l0": 0.4, "l1": 0.6}, "topic": {"t0": 0.2, "t1": 0.3, "t2": 0.5}}
    rows, miss = raked(spark, cells, targets=targets, budget_share=0.8)
    total = sum(cells.values())
    budget = 0.8 * total
    left = {s: sum(t for c, t in cells.items() if c[0] == s) for s in ("s0", "s1")}
    wanted = [
        {"s3": 0.93 * budget, "s2": 0.06 * budget, **{s: 0.01 * budget * t / sum(left.values()) for s, t in left.items()}},
        {"l0": 0.4 * budget, "l1": 0.6 * budget},
        {"t0": 0.2 * budget, "t1": 0.3 * budget, "t2": 0.5 * budget},
    ]
    assert miss <= 1e-6 and sum(r.expected for r in rows.values()) == pytest.approx(budget, rel=1e-5)
    assert sum(r.probability >= 1 for r in rows.values()) > 0
    for c, p in plain_rake(cells, wanted, 0.8).items():
        assert rows[c].probability == pytest.approx(p, abs=2e-4)


def test_targets_beyond_what_there_is(spark):
    cells = {("small", "en", "t"): 100, ("big", "en", "t"): 800, ("other", "en", "t"): 100}
    rows, miss = raked(spark, cells, targets={"source": {"small": 0.5, "big": 0.4, "other": 0.1}}, budget_share=0.5)
    # The small source is taken whole; 400 of 500 are left to the others, four to one, and the other has but 100.
    assert miss < 1e-6 and [rows[c].expected for c in cells] == pytest.approx([100, 320, 80])
    apart = {("a", "en", "x"): 100, ("b", "fr", "y"): 100}
    with pytest.warns(UserWarning, match="misses its target"):
        _, miss = raked(spark, apart, targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "fr": 0.9}}, budget_share=0.2, max_rounds=6)
    assert miss > 0.1


def test_many_cells_and_a_topic_column(spark):
    docs = mixed_documents(spark).withColumn("subject", F.expr("if(doc_id % 4 = 0, null, concat('topic ', doc_id % 4))"))
    found = [sorted((r.doc_id, r.mix_tokens, r.mix_topic, round(r.probability, 9), r.sampled) for r in mix_sources(docs, topic="subject", small_cells=n).collect()) for n in (10**6, 0)]
    assert found[0] == found[1] and {r[2] for r in found[0]} == {"", "topic 1", "topic 2", "topic 3"}


def luhn(text):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", text))]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


PII = [
    "card 4737097684299439, again 4737 0976 8429 9439.",
    "not a card 4737097684299438 nor 12345",
    "ip 233.233.171.252!! but not 999.1.1.1 or 1.2.3.4.5",
    "call +1 (017) 555-7713 or +49 30 1234567.",
    "mail Ana.Ñ@mail7.example.com###",
    "born 1999-02-28, 28.02.1999, 1999/02/28; no day 1999-02-30",
    "ssn 123-45-6789",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###',
    "plain text without any, version 4.0.",
    None,
    "",
    "call +1 (017) 555-7713 again, " + "long " * 5000,
]


def keys(spark, *found):
    return spark.createDataFrame([(k,) for k in found or ("secret-k0",)], "key string")


def test_pseudonyms(spark):
    docs = spark.createDataFrame([(i, t, "keep", 7) for i, t in enumerate(PII)], "doc_id long, text string, source string, pii_kinds int")
    rows = {r.doc_id: r for r in pseudonymise(docs, keys(spark, "k1")).collect()}
    out = {i: r.text for i, r in rows.items()}
    assert {i: r.pii_kinds for i, r in rows.items()} == {0: ["card", "card"], 1: [], 2: ["ip"], 3: ["phone", "phone"], 4: ["email"], 5: ["date"] * 3, 6: ["ssn"], 7: ["secret"], 8: [], 9: [], 10: [], 11: ["phone"]}
    assert all(r.source == "keep" for r in rows.values())
    for i in (1, 8, 9, 10):
        assert out[i] == PII[i]
    a, b = re.search(r"card (\d{16}), again (\d{4} \d{4} \d{4} \d{4})\.", out[0]).groups()
    assert a == b.replace(" ", "") and luhn(a) and a not in PII[0]
    assert all(int(x) < 256 for x in re.search(r"ip ([\d.]+)!!", out[2])[1].split(".")) and "233.233" not in out[2] and "999.1.1.1" in out[2]
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[3])[0]
    assert phone in out[11] and phone not in PII[3] and re.search(r"\+49 \d\d \d{7}\.", out[3])
    assert out[11].endswith("long " * 5000)
    assert "Ana" not in out[4] and out[4].endswith("###")
    dates = re.search(r"born (\d{4}-\d\d-\d\d), (\d\d\.\d\d\.\d{4}), (\d{4}/\d\d/\d\d); no day 1999-02-30", out[5]).groups()
    day = datetime.date.fromisoformat(dates[0])
    assert dates[1] == day.strftime("%d.%m.%Y") and dates[2] == day.strftime("%Y/%m/%d") and dates[0] != "1999-02-28"
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4}", out[6]) and out[6] != PII[6]
    assert re.fullmatch(r'token = "[0-9a-f]{40}"###', out[7]) and out[7] != PII[7]
    other = {r.doc_id: r.text for r in pseudonymise(docs, keys(spark, "k2")).collect()}
    assert other[0] != out[0]


def plain_feistel(left, right, a, b, key, tweak):
    """The network written out with integers."""
    for i in range(1, ROUNDS + 1):
        half = right if i % 2 else left
        number = int(hashlib.sha256(f"{key}|{tweak}|{i}|{half}".encode()).hexdigest()[:15], 16)
        left, right = ((left + number) % a, right) if i % 2 else (left, (right + number) % b)
    return left, right


def test_pseudonyms_equal_a_plain_feistel(spark):
    docs = spark.createDataFrame([(0, "ip 10.1.2.3"), (1, "1999-02-28"), (2, "ssn 123-45-6789")], "doc_id long, text string")
    out = [r.text for r in pseudonymise(docs, keys(spark, "k")).orderBy("doc_id").collect()]
    left, right = plain_feistel(10 * 256 + 1, 2 * 256 + 3, 65536, 65536, "k", "ip")
    assert out[0] == f"ip {left // 256}.{left % 256}.{right // 256}.{right % 256}"
    day = (datetime.date(1999, 2, 28) - datetime.date(1800, 1, 1)).days
    left, right = plain_feistel(day // 773, day % 773, 189, 773, "k", "date")
    assert out[1] == (datetime.date(1800, 1, 1) + datetime.timedelta(left * 773 + right)).isoformat()
    left, right = plain_feistel(122 * 99 + 44, 6788, 898 * 99, 9999, "k", "ssn")
    area = left // 99
    assert out[2] == f"ssn {area + (1 if area < 665 else 2):03d}-{left % 99 + 1:02d}-{right + 1:04d}"


def test_every_date_has_a_pseudonym_of_its_own(spark):
    """All strings of the cycle in every layout: as many real dates out as in, and in the same layout."""
    days = spark.range(146097).selectExpr("date_add(DATE'1800-01-01', cast(id AS int)) AS day")
    for form in ("dd.MM.yyyy",):  # the other layouts with one reading share its permutation
        texts = days.selectExpr(f"date_format(day, '{form}') AS text")
        assert pseudonymise(texts, keys(spark)).where(f"try_to_timestamp(text, '{form}') IS NOT NULL").select("text").distinct().count() == 146097
    slashes = days.selectExpr("explode(array(date_format(day, 'dd/MM/yyyy'), date_format(day, 'MM/dd/yyyy'))) AS text").distinct()
    out = pseudonymise(slashes, keys(spark)).where("array_size(pii_kinds) = 1 AND coalesce(try_to_timestamp(text, 'MM/dd/yyyy'), try_to_timestamp(text, 'dd/MM/yyyy')) IS NOT NULL")
    assert slashes.count() == out.select("text").distinct().count() == 234594


def test_numbers_are_permuted_among_valid_ones(spark):
    rows = [(i, f"ip 10.0.{i // 256}.{i % 256} ssn {i + 1 + (i > 664):03d}-01-0001") for i in range(800)]
    nines = [(2000 + i, f"{900 + i % 100}-{(50, 65, 70, 88, 99)[i % 5]}-{i:04d}") for i in range(400)]
    wrong = [(5000, "000-12-3456"), (5001, "666-12-3456"), (5002, "123-00-4567"), (5003, "123-45-0000"), (5004, "900-12-3456")]
    docs = spark.createDataFrame(rows + nines + wrong, "doc_id long, text string")
    found = {r.doc_id: r.text for r in pseudonymise(docs, keys(spark)).collect()}
    assert len(set(found.values())) == 1205
    assert all(found[i] == t for i, t in wrong)
    groups = {*range(50, 66), *range(70, 89), *range(90, 93), *range(94, 100)}
    for i, _ in rows:
        area, group, serial = found[i].split(" ssn ")[1].split("-")
        assert area not in ("000", "666") and area < "900" and group != "00" and serial != "0000" and len(area + group + serial) == 9
    for i, t in nines:
        area, group, serial = found[i].split("-")
        assert found[i] != t and area >= "900" and int(group) in groups and len(area + group + serial) == 9


def test_the_key_is_in_no_plan_and_must_be_there(spark):
    docs = spark.createDataFrame([(1, "ip 10.0.0.1", "x")], "doc_id long, text string, pii_kinds string")
    masked = pseudonymise(docs, keys(spark, "secret-k9"))
    assert "secret-k9" not in masked._jdf.queryExecution().toString() and masked.columns == docs.columns
    for wrong in (keys(spark).limit(0), spark.createDataFrame([(None,)], "key string"), keys(spark, "a", "b")):
        with pytest.raises(Exception, match="key|MULTIPLE|SCALAR|more than one row"):
            pseudonymise(docs, wrong).collect()


def test_pseudonyms_of_an_empty_table(spark):
    assert pseudonymise(spark.createDataFrame([], "doc_id long, text string"), keys(spark)).count() == 0


def test_values_with_something_after_them(spark):
    cards = ["4111 1111 1111 1111 12/27", "4111111111111111 2025-01-02", "12 4111 1111 1111 1111 123", "4222222222222 4111 1111 1111 1111", "4111-1111-1111-1111 28.02.1999", "3782 822463 10005 12/27", "41111111 11111111 12/27", "4111111111111111 12th"]
    mails = ["write to john@example.com.", "john@example.com.5 more", "john@mail.example.com. Then", "(john@example.com)"]
    plain = ["4111 1111 1111 1112 12/27", "john@example", "john@.com", "10 20 30 40 50 60 70 80 90 10 20 30"]
    docs = spark.createDataFrame(list(enumerate(cards + mails + plain)), "doc_id long, text string")
    rows = [r for r in pseudonymise(docs, keys(spark)).orderBy("doc_id").collect()]
    kinds = [r.pii_kinds for r in rows]
    assert kinds == [["card"], ["card", "date"], ["card"], ["card", "card"], ["card", "date"], ["card"], ["card"], ["card"], *[["email"]] * 4, *[[]] * 4]
    out = [r.text for r in rows]
    assert not any("1111" in t.replace(" ", "").replace("-", "") or "john" in t for t in out[:12])
    assert out[0].endswith(" 12/27") and luhn(out[0][:19]) and out[2].startswith("12 ") and out[2].endswith(" 123") and luhn(out[2][3:22])
    assert out[7].endswith(" 12th") and out[8].endswith(".example.") and out[9].endswith(".example.5 more") and out[12:] == plain
