import pytest
from pyspark.sql import functions as F

from mailsieve.constants import CUE_NAMES
from mailsieve.functions import cues as C
from mailsieve.functions.domains import registered_domain, url_host

# Detector test messages with their full cue vectors.
GOLDEN = [
    (
        "Kia ora, Inland Revenue has approved your tax refund of NZ$842.50. "
        "Confirm your bank details at https://ird-refund-portal.com to receive payment. "
        "Call 021 555 1234 if you need help.",
        [1, 0, 0, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0, 0],
    ),
    (
        "NZ Post: Your parcel is held due to unpaid customs fee. "
        "Pay $3.20 at https://nzpost-redeliver.xyz",
        [1, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0, 0],
    ),
    (
        "NZ Post redelivery notice: your parcel held at depot. "
        "Pay the customs fee to schedule redelivery.",
        [1, 0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    ),
    ("Hi Sarah, just confirming dinner on Friday at 7pm. Cheers.", [0] * 14),
    (
        "АNZ Bank security alert: log in at https://аnz-secure.co to verify",
        [0, 0, 0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 2, 0],
    ),
    (None, [0] * 14),
    ("", [0] * 14),
]

# Text, and the cues that are not zero in it.
CASES = [
    ("your account", {"impersonated_govt": 1}),
    ("ＡＮＺ", {"impersonated_bank": 1}),
    ("mōrena", {"te_reo_salutation": 1}),
    ("mōrena", {"te_reo_salutation": 1}),
    ("morena", {"te_reo_salutation": 1}),
    ("tsb and bnz and tsb", {"impersonated_bank": 1}),
    ("https://anz.co.nz/x", {"impersonated_bank": 1, "url_count": 1}),
    ("https://anz.other.example", {"impersonated_bank": 1, "url_count": 1}),
    (
        "https://my-anz.example https://ird-and-bnz.example",
        {
            "impersonated_govt": 1, "impersonated_bank": 1, "url_count": 2,
            "suspicious_govt_lookalike": 1, "suspicious_bank_lookalike": 2,
        },
    ),
    ("HTTP://XN--A.example", {"url_count": 1, "has_punycode": 1}),
    ("+64 21 555 1234", {"nz_mobile_count": 1, "nz_postcode_count": 1}),
    ("03 555 1234", {"nz_landline_count": 1, "nz_postcode_count": 1}),
    ("٠١ 03٥٥٥١٢٣٤", {"nz_landline_count": 1}),
    ("nzd $5,50 and NZ$ 3 and $NZ7", {"nzd_mention_count": 3}),
    ("1234 5678 a9999 é8888", {"nz_postcode_count": 2}),
    ("ӀСс", {"homoglyph_chars": 3}),
]


def test_golden_vectors(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GOLDEN)], "i int, text string")
    out = C.extract_cues(rows).orderBy("i")
    assert out.columns == ["i", "text", *CUE_NAMES]
    for row, (text, vector) in zip(out.collect(), GOLDEN, strict=True):
        assert [row[n] for n in CUE_NAMES] == vector, text
        assert row["text"] == text


def test_single_cues(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    for row, (text, some) in zip(C.extract_cues(rows).orderBy("i").collect(), CASES, strict=True):
        assert {n: row[n] for n in CUE_NAMES if row[n]} == some, ascii(text)


def test_cue_selection_keeps_order(spark):
    rows = spark.createDataFrame([("bnz 1234",)], "text string")
    names = ["nz_postcode_count", "impersonated_bank"]
    assert C.extract_cues(rows, names=names).columns == ["text", *names]
    with pytest.raises(ValueError, match="unknown cues"):
        C.extract_cues(rows, names=["other"])


def test_column_called_like_a_helper(spark):
    rows = spark.createDataFrame([("https://my-anz.example", "c")], "text string, c string")
    assert C.extract_cues(rows).first()["suspicious_bank_lookalike"] == 1


URLS = [
    ("https://a.b.Example.CO.NZ/x", "a.b.example.co.nz", "example.co.nz"),
    ("http://user:pw@host.example.com:8080/p", "host.example.com", "example.com"),
    ("http://a@b@host.example.com", "host.example.com", "example.com"),
    ("http://host.example.com.", "host.example.com", "example.com"),
    ("https://аnz-secure.co", "аnz-secure.co", "аnz-secure.co"),
    ("https://under_score.example.net?q=a b", "under_score.example.net", "example.net"),
    ("https://a.b.unknown", "a.b.unknown", "unknown"),
    ("https://10.0.0.1/x", "10.0.0.1", "10.0.0.1"),
    ("https://co.nz", "co.nz", "co.nz"),
    ("https://www。example．com", "www.example.com", "example.com"),
    ("https://localhost", "localhost", "localhost"),
    ("not a url", "", ""),
]


def test_hosts_and_registered_domains(spark):
    rows = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "i int, u string")
    out = rows.select("i", url_host(F.col("u")).alias("h"), registered_domain(F.col("u")).alias("d"))
    for row, (url, host, domain) in zip(out.orderBy("i").collect(), URLS, strict=True):
        assert (row["h"], row["d"]) == (host, domain), ascii(url)


def test_cues_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(t,) for t, _ in GOLDEN], "text string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in"))
    query = (
        C.extract_cues(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.exceptAll(C.extract_cues(rows)).isEmpty() and got.count() == len(GOLDEN)


@pytest.mark.parametrize(
    "url", ["https://ird-refund.top/x", "https://anz-login.info", "https://nzpost.com.au/x", "https://kiwibank-secure.co.uk", "https://bnz-alert.click"]
)
def test_lookalikes_under_other_suffixes(spark, url):
    found = C.extract_cues(spark.createDataFrame([(url,)], "text string")).first()
    assert found["suspicious_govt_lookalike"] + found["suspicious_bank_lookalike"] == 1


def test_suffix_rules_of_the_public_list(spark, tmp_path):
    from mailsieve.functions.domains import read_suffixes, registered_domain

    (tmp_path / "list.dat").write_text("// comment\n\ncom\nck\n*.ck\n!www.ck\nco.uk // note\nuk\n*.city.jp\n")
    rules = read_suffixes(spark, str(tmp_path / "list.dat"))
    assert rules == ["com", "ck", "*.ck", "!www.ck", "co.uk", "uk", "*.city.jp"]
    cases = {"a.b.com": "b.com", "x.y.co.ck": "y.co.ck", "co.ck": "co.ck", "m.www.ck": "www.ck", "a.b.co.uk": "b.co.uk", "a.uk": "a.uk",
             "a.b.c.city.jp": "b.c.city.jp", "host.internal": "internal", "10.0.0.1": "10.0.0.1"}
    df = spark.createDataFrame([(f"https://{h}/x",) for h in cases], "u string").select(registered_domain(F.col("u"), rules))
    assert [r[0] for r in df.collect()] == list(cases.values())
