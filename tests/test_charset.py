"""Encodings guessed from bytes, and files of prompts."""

import random

import pytest
from pyspark.sql import functions as F

from runloom.functions import charset
from runloom.operators import retrieval

CHINESE = "软件工程是一门研究用工程化方法构建和维护有效的、实用的和高质量的软件的学科。它涉及程序设计语言、数据库、软件开发工具、系统平台、标准、设计模式等方面。"
KOREAN = "모든 국민은 법 앞에 평등하다. 누구든지 성별 종교 또는 사회적 신분에 의하여 차별을 받지 아니한다."
JAPANESE = "日本国民は、正当に選挙された国会における代表者を通じて行動し、われらとわれらの子孫のために、この憲法を確定する。"
TAIWAN = "臺灣位於亞洲東部，四面環海，氣候溫暖，物產豐富，人民生活安定，社會經濟發展迅速。"
FRENCH = "L'été dernier, à l'hôtel, nous avons goûté des crêpes flambées près de la forêt; ça coûtait très cher, naïvement."
GERMAN = "Größere Bücher müssen schön übersetzt werden, sagt die Prüferin."


@pytest.mark.parametrize(
    ("text", "encoding", "found"),
    [
        (CHINESE, "gbk", "gbk"), (KOREAN, "euc_kr", "euc_kr"), (JAPANESE, "shift_jis", "shift_jis"), (JAPANESE, "euc_jp", "euc_jp"), (TAIWAN, "big5", "big5"),
        (FRENCH, "latin-1", "cp1252"), (GERMAN, "cp1252", "cp1252"), (FRENCH + " \x81", "latin-1", "latin-1"), ("x = 'é'", "latin-1", "cp1252"),
        (CHINESE, "utf-8", "utf-8"), (CHINESE, "utf-8-sig", "utf-8-sig"), (CHINESE, "utf-16", "utf-16"), (FRENCH, "utf-16-le", "utf-16-le"), (FRENCH, "utf-16-be", "utf-16-be"), (FRENCH, "utf-32", "utf-32"),
        ("ENÄKEIT!! DIE " * 5, "latin-1", "cp1252"), ("nd der. Öäver die", "latin-1", "cp1252"), ("s osci. Ñíco. Ieja", "latin-1", "cp1252"), ("x = 1  # 中文", "gbk", "gbk"),
        ("", "ascii", "utf-8"), ("plain\n", "ascii", "utf-8"),
    ],
)
def test_guesses(text, encoding, found):
    assert charset.guessed(text.encode(encoding)) == (text, found)


def test_what_is_no_text():
    random.seed(4)
    assert charset.guessed(None) == (None, None)
    for raw in (b"\x7fELF\x02\x01\x01\x00" + random.randbytes(200), b"\x00", bytes(range(1, 9)) * 30 + b"\xff", b"PK\x03\x04\x00\x00"):
        assert charset.guessed(raw) == (charset.PLACEHOLDER, None)


def test_column(spark):
    rows = [(1, CHINESE.encode("gbk")), (2, FRENCH.encode()), (3, None), (4, b"\x00\x01"), (5, "x".encode("utf-8-sig"))]
    got = {r["i"]: r["x"] for r in spark.createDataFrame(rows, "i long, b binary").select("i", charset.read_text(F.col("b")).alias("x")).collect()}
    assert {i: (x["text"], x["encoding"]) for i, x in got.items()} == {1: (CHINESE, "gbk"), 2: (FRENCH, "utf-8"), 3: (None, None), 4: (charset.PLACEHOLDER, None), 5: ("x", "utf-8-sig")}


def test_prompt_files(spark):
    block = lambda f, body="x": f"[start of {f}]\n{body}\n[end of {f}]\n"
    text = block("docs/README.rst") + block("a/é.py") + block("b.py", block("c.py")) + "[start of open.py]\nx\n" + block("a/é.py") + "[start of e.py]\n[end of e.py]" + block("README")
    patch = "--- a/b.py\n+++ b/b.py\n--- a/c.py\n--- /dev/null\n--- a/b.py\n"
    rows = [(1, text, patch), (2, "nothing", patch), (3, text, "--- /dev/null\n"), (4, None, patch), (5, text, None)]
    df = spark.createDataFrame(rows, "id long, text string, patch string")
    assert df.where("id = 1").select(retrieval.prompt_files(F.col("text")).alias("f")).first()["f"] == ["a/é.py", "b.py", "README"]
    got = {r["id"]: (r["n_retrieved"], r["n_gold"], r["recall"]) for r in retrieval.prompt_recalls(df, "id", "text", "patch").collect()}
    assert got == {1: (3, 2, 0.5), 2: (0, 2, 0.0), 4: (0, 2, 0.0)}
    assert tuple(retrieval.recall_summary(retrieval.prompt_recalls(df, "id", "text", "patch")).first()) == (3, 16.67, 0.0, 33.33)
