"""Which language a text is mostly in, by the script of its letters, and where words end in scripts without blanks.

Letters vote for their script. Latin letters, and all that have no model of their own, count as English, which is what
embeds them; so languages of one script need not be told apart, but for Han: with enough kana it is Japanese, and
where characters that only traditional writing has outnumber those that only simplified writing has, it has no model.

Words of Thai, Japanese and Chinese are found in a lattice: every known word that a stretch of such letters holds is an
edge, and so is every short run of unknown ones; the cheapest way through is taken. Known words are a short list
that can be replaced or extended, for instance by what ``segment.learn_words`` counts in a corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of each script, as ranges of a character class.
THAI = "ก-ฺเ-๎"
KANA = "ぁ-ゖゝ-ゟァ-ヺー-ヿ"
HAN = "㐀-䶿一-鿿"
LETTERS = r"\p{L}\p{M}"
#: Frequent characters that only traditional, or only simplified Chinese writing has.
TRADITIONAL = "這個們來說時為會國學對發開關過還後問間見長門東車馬龍書電話語讀寫買賣錢錯鐘難題點處從當實現樣種將動無與義務業麼"
SIMPLIFIED = "这个们来说时为会国学对发开关过还后问间见长门东车马龙书电话语读写买卖钱错钟难题点处从当实现样种将动无与义务业么"

#: Frequent words.
THAI_WORDS = (
    "ที่ และ การ ใน เป็น ของ มี ได้ ไม่ ว่า จะ ให้ กับ จาก นี้ คน แต่ หรือ โดย แล้ว ความ ไป มา ผู้ อยู่ ก็ ต้อง ซึ่ง เรา เขา ฉัน คุณ นั้น ทำ อะไร เมื่อ วัน ปี กว่า ถึง ขึ้น ลง ออก เข้า ด้วย "
    "ใช้ งาน ดี มาก น้อย ทุก หนึ่ง สอง สาม บ้าน เมือง ประเทศ ไทย ภาษา ข้อความ คำ ข้อมูล ไฟล์ ระบบ โปรแกรม รัก กิน ข้าว น้ำ ยาว พอ สำหรับ"
).split()
JAPANESE_WORDS = "は が を に で と の も や へ から まで より です ます した する して いる ある こと もの ため よう これ それ あれ この その 日本 日本語 今日 明日 私 人 時間 言語 情報 データ ファイル システム テキスト".split()
CHINESE_WORDS = "的 了 是 在 我 有 和 就 不 人 都 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 我们 他们 中国 中文 语言 数据 文件 系统 问题 时间 今天 明天 可以 因为 所以 但是 如果 什么".split()

_UNSPACED = re.compile(f"[{THAI}]+|[{KANA}{HAN}]+")
#: What no word begins with (Thai vowels and marks after a consonant, small kana and the long mark), and
#: after what none ends (Thai vowels before a consonant).
_NEVER_FIRST = frozenset("ะัาำิีึืฺุูๅ็่้๊๋์ํ๎ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮー々")
_NEVER_LAST = frozenset("เแโใไ")


def unspaced(text: Column) -> Column:
    """Whether a text has letters of scripts that put no blanks between words."""
    return text.rlike(f"[{THAI}{KANA}{HAN}]")


def votes(text: Column) -> dict[str, Column]:
    """Letters by script: th, kana, han, others."""
    n = lambda of: F.regexp_count(text, F.lit(f"[{of}]"))
    own = {"th": n(THAI), "kana": n(KANA), "han": n(HAN)}
    return own | {"other": n(LETTERS) - n(f"{THAI}{KANA}{HAN}&&[{LETTERS}]")}


def dominant(text: Column) -> Column:
    """th, ja, zh-Hans or en: the language of most letters, English where that has no model or there are none."""
    v = votes(F.coalesce(text, F.lit("")))
    east = v["kana"] + v["han"]
    old, new = (F.regexp_count(text, F.lit(f"[{x}]")) for x in ("".join(a for a, b in zip(TRADITIONAL, SIMPLIFIED) if a != b), "".join(b for a, b in zip(TRADITIONAL, SIMPLIFIED) if a != b)))
    return (
        F.when((v["th"] > v["other"]) & (v["th"] > east), "th")
        .when((east > v["other"]) & (east >= v["th"]) & (v["kana"] * 10 >= east), "ja")
        .when((east > v["other"]) & (east >= v["th"]) & (old <= new), "zh-Hans")
        .otherwise("en")
    )


class Lattice:
    """words: (word, count) pairs, or words alone; longest: letters of a run of unknown ones."""

    def __init__(self, words: Iterable[tuple[str, float]] | Iterable[str] = (*THAI_WORDS, *JAPANESE_WORDS, *CHINESE_WORDS), longest: int = 8):
        counted = [(w, 1.0) if isinstance(w, str) else (w[0], float(w[1])) for w in words]
        total = sum(n for _, n in counted) + 1
        self.costs = {w: math.log(total / n) for w, n in counted if w and n > 0}
        self.most = max(map(len, self.costs), default=0)
        #: A further unknown letter costs more than any known word, and beginning a run of them more than that.
        self.further = max(self.costs.values(), default=1.0) + 0.5
        self.first, self.longest = self.further + 1.5, longest

    def _words(self, run: str) -> list[int]:
        """Where the words of a run of letters end."""
        n = len(run)
        may_break = [True] + [run[i] not in _NEVER_FIRST and run[i - 1] not in _NEVER_LAST for i in range(1, n)] + [True]
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        for i in range(n):
            if best[i] == math.inf or not may_break[i]:
                continue
            last = 0
            for j in range(i + 1, min(n, i + max(self.most, self.longest)) + 1):
                if not may_break[j]:
                    continue
                cost = self.costs.get(run[i:j])
                if cost is None and j - i <= self.longest or not last:
                    unknown = self.first + self.further * (j - i - 1)
                    cost = unknown if cost is None else min(cost, unknown)
                last = j
                if cost is not None and best[i] + cost < best[j]:
                    best[j], back[j] = best[i] + cost, i
            if not last:  # nothing but marks follow
                best[n], back[n] = min((best[n], back[n]), (best[i] + self.first, i))
        ends, at = [], n
        while at > 0:
            ends.append(at)
            at = back[at]
        return ends[::-1]

    def ranges(self, text: str) -> list[tuple[int, int]]:
        """(begin, end) of each word: stretches without blanks, cut further where letters of unspaced scripts stand."""
        out: list[tuple[int, int]] = []
        for token in re.finditer(r"\S+", text):
            at = token.start()
            for run in _UNSPACED.finditer(text, token.start(), token.end()):
                if run.start() > at:
                    out.append((at, run.start()))
                at = run.start()
                for end in self._words(run[0]):
                    out.append((at, run.start() + end))
                    at = run.start() + end
            if at < token.end():
                out.append((at, token.end()))
        return out


def windows(text: str, ranges: list[tuple[int, int]], words: int, stride: int, most: int) -> list[str]:
    """The text from the first to the last word of each window; a text of no more than one window is its one chunk."""
    if len(ranges) <= words:
        return [text] if text else []
    out, i = [], 0
    while not most or len(out) < most:
        last = min(i + words, len(ranges))
        out.append(text[ranges[i][0] : ranges[last - 1][1]])
        if last == len(ranges):
            break
        i += stride
    return out
