"""Dominant languages and words of scripts without blanks."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from logloom import schemas
from logloom.functions import language
from logloom.operators import segment, sequence, vectors

THAI = "ฉันรักภาษาไทยและข้อความที่ยาวพอสำหรับคุณ"


def test_the_language_of_most_letters(spark):
    texts = {
        "an English text with one Thai letter ก": "en", "ก": "th", THAI: "th", THAI + " with words": "th", "some " * 20 + THAI: "en", "": "en", None: "en", "12 34 !": "en", "Привет, мир": "en",
        "東京都の学校で日本語を学ぶ": "ja", "我们在学校学习中文和语言": "zh-Hans", "我們在學校學習中文和語言這個": "en", "カタカナ": "ja", "naïve café": "en", "한국어 텍스트": "en", "漢字": "zh-Hans", "log の file": "en",
    }
    frame = spark.createDataFrame([(t,) for t in texts], "text string").select("text", language.dominant(F.col("text")).alias("l"))
    assert {r["text"]: r["l"] for r in frame.collect()} == texts
    assert frame.select(vectors.script_model(F.col("text")).alias("m")).distinct().count() == 4


def cheapest(lattice, run):
    """The least cost of any way to cut a run, by trying all."""
    best = math.inf
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
        cost = 0.0
        for a, b in zip(at, at[1:]):
            unknown = lattice.first + lattice.further * (b - a - 1) if b - a <= lattice.longest else math.inf
            cost += min(lattice.costs.get(run[a:b], math.inf), unknown)
        best = min(best, cost)
    return best


def test_words_are_the_cheapest_way_through_the_lattice():
    rng = random.Random(1)
    letters = "กขคงจ"
    for _ in range(200):
        known = {("".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))), rng.randrange(1, 50)) for _ in range(8)}
        lattice = language.Lattice(dict(known).items(), longest=4)
        run = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 11)))
        ends = lattice._words(run)
        cost = sum(min(lattice.costs.get(run[a:b], math.inf), lattice.first + lattice.further * (b - a - 1) if b - a <= 4 else math.inf) for a, b in zip([0, *ends], ends))
        assert ends[-1] == len(run) and abs(cost - cheapest(lattice, run)) < 1e-9


def test_segments_of_mixed_texts():
    lattice = language.Lattice()
    cut = lambda t: [t[a:b] for a, b in lattice.ranges(t)]
    assert cut(THAI) == ["ฉัน", "รัก", "ภาษา", "ไทย", "และ", "ข้อความ", "ที่", "ยาว", "พอ", "สำหรับ", "คุณ"]
    assert cut("plain words, as ever") == ["plain", "words,", "as", "ever"] and cut("") == [] and cut("  ") == []
    assert cut("私は日本語 file.txt") == ["私", "は", "日本語", "file.txt"]
    for t in ("เแโใไ", "่่่", "ะ", "กะะะ" * 30, "ーー", "เ" * 20 + "ก", THAI * 50):
        ranges = lattice.ranges(t)
        assert "".join(t[a:b] for a, b in ranges) == t and all(a < b for a, b in ranges)
        assert all(t[a] not in language._NEVER_FIRST for a, _ in ranges[1:])


def test_a_long_thai_text_is_several_chunks(spark):
    words = [language.THAI_WORDS[k % len(language.THAI_WORDS)] for k in range(300)]
    plain = " ".join(f"w{k}" for k in range(250))
    rows = [(1, 1, "user", None, "".join(words)), (1, 2, "user", None, plain), (1, 3, "user", None, None), (1, 4, "user", None, ""), (1, 5, "user", None, " ก \n ข ")]
    events = spark.createDataFrame(rows, schemas.EVENTS)
    got = sequence.chunks(events, 100, 50).orderBy("seq", "chunk_index").collect()
    thai = [r["text"] for r in got if r["seq"] == 1]
    assert len(thai) >= 4 and thai[0] == "".join(words)[: len(thai[0])] and "".join(words).endswith(thai[-1])
    assert [r["text"] for r in got if r["seq"] == 5] == ["ก ข"]
    # texts with blanks come out as they did
    key = lambda df: sorted(map(tuple, df.where("seq <> 1 AND seq <> 5").select("session_id", "seq", "chunk_index", "text").collect()))
    assert key(sequence.chunks(events, 100, 50)) == key(sequence.chunks(events, 100, 50, segmenter=None)) != []
    assert sequence.chunks(events, 100, 50, 2).where("seq = 1").count() == 2
    each = lambda text: [(k, k + 1) for k in range(len(text))]
    assert sequence.chunks(events.where("seq = 1"), 10, 10, 0, segmenter=each).count() == math.ceil(len("".join(words)) / 10)
    assert vectors.build_embeddings(events.where("seq = 1"), spark.createDataFrame([], schemas.EVENT_VECTORS), ["hash/en/r1/64"]).where("model LIKE '%/th/%'").count() >= 4


@pytest.mark.parametrize("script", ["กขคงจชดตทนบปผพฟมยรลวสหอ", "学校東京都語書車馬門見長国人時間日本言電話力"])
def test_words_are_learned_from_a_corpus(spark, script):
    rng = random.Random(5)
    words = list({"".join(rng.choice(script) for _ in range(rng.choice([2, 3, 3, 4]))) for _ in range(60)})
    texts = [[rng.choice(words) for _ in range(40)] for _ in range(150)]
    events = spark.createDataFrame([(k, 0, "".join(t)) for k, t in enumerate(texts)], "session_id long, seq long, text string")
    learned = {r["word"]: r["count"] for r in segment.learn_words(events, cohesion=1.5).collect()}
    assert len(set(words) & learned.keys()) >= 0.7 * len(words)
    lattice = language.Lattice(learned.items())
    right = total = 0
    for t in texts[:40]:
        whole = "".join(t)
        ends = {b for _, b in lattice.ranges(whole)}
        truth = set(itertools.accumulate(map(len, t)))
        right, total = right + len(ends & truth), total + len(ends | truth)
    assert right / total > 0.6
    assert segment.learn_words(events.where("false")).count() == 0
