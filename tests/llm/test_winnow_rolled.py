import random
import re

from pyspark.sql import functions as F

from matchweave.llm import queries, winnow


def slow_tokens(text):
    out = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text):
        out += [word] if len(word) <= 8 else [word[i : i + 8] for i in range(len(word) - 7)]
    return out


def test_rolled_tokens_against_plain_loops(spark):
    rng = random.Random(3)
    texts = ["", " ", "a", "12345678", "123456789", " 1234567 123456789012 x\n", "日本語のとても長い文章です 短い", "\U0001f600" * 10 + " é" * 9]
    texts += ["".join(rng.choices("ab一\U0001f600 \t", [5, 5, 5, 2, 1, 1], k=80)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", F.regexp_extract_all("t", F.lit(winnow.ROLLED), F.lit(1)).alias("r")).collect()
    assert all(r["r"] == slow_tokens(r["t"]) for r in got)


def test_shifted_passage_without_spaces_is_found(spark, tmp_path):
    rng = random.Random(5)
    chars = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    shared = chars(2000)
    # of the two rows the next of the larger id is the smaller, which holds the passage shifted
    for shift in (1, 4, 7):
        folder = f"{tmp_path}/{shift}"
        rows = [(1, chars(shift) + shared), (2, shared)]
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
        got = {r["doc_id"]: r["near_next"] for r in queries.op2_winnowing(spark, folder).collect()}
        assert got[2] > 0.95


def test_short_shared_passage_is_found_at_any_offset(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    text = lambda n: "".join(rng.choices(letters, k=n))
    rows = []
    for n in range(50):  # six tokens of eight code points, one apart
        shared = text(8 + winnow.K + 2**winnow.WINDOW_DOUBLINGS - 2)
        rows.append((text(20 + n) + shared + text(30), text(25 + 2 * n) + shared + text(9)))
    df = spark.createDataFrame(rows, "x string, y string")
    for c in ("x", "y"):
        df = winnow.with_fingerprint(df, c, f"{c}{c}", rolled=True).withColumn(f"{c}_hashes", winnow.hashes(f"{c}{c}_chosen"))
    assert all(r[0] > 0 for r in df.select(winnow.likeness("x_hashes", "y_hashes")).collect())
