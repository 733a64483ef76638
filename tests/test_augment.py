import hashlib
import json

import pytest
from pyspark.sql import functions as F

from mailsieve.functions.hashing import cache_key
from mailsieve.operators import augment as A
from mailsieve.operators.templates import Cell, expand_templates
from mailsieve.sources.cache import append_cache, read_cache

SETTINGS = A.ParaphraseSettings("some-model")
SCHEMA = "id string, text string, channel string, label int, source string, lang string"


def _rows(spark, texts):
    return spark.createDataFrame(
        [(f"m{i}", t, "sms", i % 2, "s", "en") for i, t in enumerate(texts)], SCHEMA
    )


def _key(text, model="some-model", n=4, temperature=0.9, seed=42):
    return hashlib.sha256(f"{text}{model}{n}{temperature}{seed}".encode()).hexdigest()


def test_cache_keys(spark):
    df = spark.createDataFrame([("hello",), ("world",), ("tēnā",)], "t string")
    plain = [r[0] for r in df.select(cache_key(F.col("t"), "some-model", 4, 0.9, 42)).collect()]
    assert plain == [_key("hello"), _key("world"), _key("tēnā")]
    apart = [
        df.select(cache_key(F.col("t"), "some-model", n, 0.9, s, sep)).first()[0]
        for n, s, sep in ((4, 42, ""), (3, 42, ""), (4, 1, ""), (4, 42, "\x01"))
    ]
    assert len(set(apart)) == 4


RESPONSES = [
    ('{"paraphrases": [" One ", "", "two", 3, null, "HELLO", "two"]}', ["One", "two", "two"]),
    (' {"paraphrases": ["a"], "x": 1} ', ["a"]),
    ('{"other": ["a"]}', []),
    ('{"paraphrases": "a"}', []),
    ('["a"]', []),
    ("not json", []),
    ("", []),
    (None, []),
]


def test_responses(spark):
    df = spark.createDataFrame([(i, r, "Hello") for i, (r, _) in enumerate(RESPONSES)], "i int, raw string, text string")
    got = df.select("i", A.clean_paraphrases(A.parse_response(F.col("raw")), F.col("text")).alias("p"))
    assert [r["p"] for r in got.orderBy("i").collect()] == [p for _, p in RESPONSES]


def test_prompt(spark):
    df = spark.createDataFrame([("the text",)], "t string")
    prompt = df.select(A.build_prompt(F.col("t"), "Give {n} versions.", 3)).first()[0]
    assert prompt.startswith("Give 3 versions.\n\nORIGINAL:\nthe text\n\nRespond with valid JSON only: ")


def _provider(log, quota=None, fail=False):
    def ask(prompt):
        text = prompt.split("ORIGINAL:\n")[1].split("\n\nRespond")[0]
        if fail and text == "bad":
            raise OSError("no line")
        if quota is not None and text in quota:
            raise A.QuotaExhausted("later")
        with open(log, "a") as out:
            out.write(text + "\n")
        return json.dumps({"paraphrases": [text + " again", text.upper(), text + " more"]})

    return ask


def test_augment_asks_once_and_resumes(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    df = _rows(spark, ["one", "two", "one", "three"])
    run = lambda provider: A.augment(df, cache, provider, "Give {n}.", SETTINGS)
    first = run(_provider(log, quota={"three", "two", "one"}))
    assert tuple(A.augment_summary(first).first()) == (4, 0, 4, 0)
    second = run(_provider(log))
    assert sorted(log.read_text().split()) == ["one", "three", "two"]
    assert tuple(A.augment_summary(second).first()) == (4, 4, 0, 8)
    third = run(_provider(log, quota={"one", "two", "three"}))
    assert third.exceptAll(second).isEmpty() and third.count() == 4
    assert len(log.read_text().split()) == 3
    grown = {(r["id"], r["text"], r["source"], r["label"]) for r in A.expand_paraphrases(third).collect()}
    assert ("m0__para_0", "one again", "nz_synth_para", 0) in grown
    assert ("m3__para_1", "three more", "nz_synth_para", 1) in grown and len(grown) == 8


def test_failure_keeps_earlier_answers(spark, tmp_path):
    log, cache = tmp_path / "log", str(tmp_path / "cache")
    df = _rows(spark, ["good", "bad"])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError, match="no line"):
        A.augment(df.where("text = 'bad'"), cache, _provider(log, fail=True), "Give {n}.", SETTINGS)
    A.augment(df.where("text = 'good'"), cache, _provider(log, fail=True), "Give {n}.", SETTINGS)
    with pytest.raises(RuntimeError, match="no line"):
        A.augment(df, cache, _provider(log, fail=True), "Give {n}.", SETTINGS)
    assert read_cache(spark, cache).count() == 1 and before


def test_the_last_answer_of_a_key_wins(spark, tmp_path):
    cache = str(tmp_path / "cache")
    for answer in ("first", "second", "third"):
        rows = spark.createDataFrame([("k", [answer]), (answer, [answer])], "cache_key string, paraphrases array<string>")
        append_cache(rows, cache)
    assert {r["cache_key"]: r["paraphrases"] for r in read_cache(spark, cache).collect()}["k"] == ["third"]


def test_rounds_are_kept_one_by_one_and_calls_are_spread(spark, tmp_path):
    texts = [f"text {i}" for i in range(300)]
    df, cache, seen = _rows(spark, texts), str(tmp_path / "cache"), tmp_path / "tasks"
    seen.mkdir()

    def provider(prompt):
        from pyspark import TaskContext

        (seen / str(TaskContext.get().taskAttemptId())).touch()
        return json.dumps({"paraphrases": [prompt[-200:] + " again"]})

    A.augment(df.limit(100), str(tmp_path / "other"), provider, "Give {n}.", SETTINGS, parallel_calls=16, rounds=2)
    assert len(list(seen.iterdir())) >= 16
    late = {r["text"] for r in A.with_cache_key(df, SETTINGS).where(F.pmod(F.xxhash64("cache_key"), F.lit(4)) >= 1).collect()}

    def dies(prompt):
        text = prompt.split("ORIGINAL:\n")[1].split("\n\nRespond")[0]
        if text in late:
            raise OSError("killed")
        return json.dumps({"paraphrases": [text + " again"]})

    with pytest.raises(RuntimeError, match="killed"):
        A.augment(df, cache, dies, "Give {n}.", SETTINGS, rounds=4)
    assert read_cache(spark, cache).count() == 300 - len(late) > 0


def test_split_cached_and_broken_file(spark, tmp_path):
    cache = tmp_path / "cache"
    df = A.with_cache_key(_rows(spark, ["one", "two", "two"]), SETTINGS)
    answers = spark.createDataFrame([(_key("one"), ["1"]), (_key("none"), None)], "cache_key string, paraphrases array<string>")
    append_cache(answers, str(cache))
    append_cache(answers, str(cache))
    (cache / "part-broken.parquet").write_bytes(b"not parquet")
    with pytest.raises(Exception, match="part-broken"):
        read_cache(spark, str(cache)).collect()
    hits, pending = A.split_cached(df, read_cache(spark, str(cache), skip_corrupt=True))
    assert [r["id"] for r in hits.collect()] == ["m0"]
    assert [r["text"] for r in pending.collect()] == ["two"]


def test_templates(spark):
    cells = [
        Cell("email", 1, ["Notice {name}: {amt} at {dom}", "{dom} asks {name}"], {"dom": ["a.example"]}),
        Cell("sms", 0, ["Hi {name}"], {"dom": ["b.example"]}),
    ]
    slots = {"name": ["Ann", "Bob", "Cy"], "amt": ["$1.00", "$$2"]}
    out = expand_templates(spark.range(200).withColumnRenamed("id", "i"), cells, slots, seed=3)
    rows = out.collect()
    assert len(rows) == 400 and len({r["id"] for r in rows}) == 400
    assert {r["id"] for r in rows} >= {"nz_synth_email_1_0", "nz_synth_sms_0_199"}
    texts = {r["text"] for r in rows if r["channel"] == "email"}
    expected = {f"Notice {n}: {a} at a.example" for n in slots["name"] for a in ("1.00", "2")}
    assert texts == expected | {f"a.example asks {n}" for n in slots["name"]}
    assert {r["text"] for r in rows if r["label"] == 0} == {"Hi Ann", "Hi Bob", "Hi Cy"}
    again = expand_templates(spark.range(200).repartition(5).withColumnRenamed("id", "i"), cells, slots, seed=3)
    assert again.exceptAll(out).isEmpty()
    other = expand_templates(spark.range(200).withColumnRenamed("id", "i"), cells, slots, seed=4)
    assert not other.exceptAll(out).isEmpty()


def test_slots_are_filled_once(spark):
    rows = spark.createDataFrame([(0, "A {dom} {{x}}")], "i long, name string")
    cells = [Cell("sms", 0, ["{{{name}}} at {dom}"], {"dom": ["b.example"]})]
    out = expand_templates(rows, cells, {"name": F.col("name")})
    assert out.first()["text"] == "{A {dom} {{x}}} at b.example"
    with pytest.raises(KeyError, match="unknown"):
        expand_templates(rows, [Cell("sms", 0, ["{nobody}"], {})], {})
