"""Quality rules on scripts without case, by an oracle that knows letters by their Unicode names."""

from __future__ import annotations

import unicodedata

import pytest

from arbordex.llm import quality_rules

#: For each script: letters and signs of its words, and how the names of all its letters and signs begin.
SCRIPTS = {
    "ar": ("ابتثجحخدذرزسشصضطظعغفقكلمنهوي", ("ARABIC LETTER",)),
    "he": ("אבגדהוזחטיכלמנסעפצקרשת", ("HEBREW LETTER",)),
    "hi": ("किखीगुघूचेछैजोझौटंठःडढणतथदधनपफबभम", ("DEVANAGARI LETTER", "DEVANAGARI VOWEL SIGN", "DEVANAGARI SIGN")),
    "ko": ("가나다라마바사아자차카타파하거너더러머버서어", ("HANGUL SYLLABLE",)),
    "th": ("กิขีคึงืจุฉูช่ซ้ญ๊ด๋ต์ถทธนบปผฝพฟภมยรลวศษสหอฮ", ("THAI CHARACTER",)),
    "zh": ("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", ("CJK UNIFIED IDEOGRAPH",)),
    "beyond": ("𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇𠀈𠀉𠀊𠀋", ("CJK UNIFIED IDEOGRAPH",)),
    "en": ("abcdefghijklmnopqrstuvwxyz", ("LATIN SMALL LETTER",)),
}


def clean(letters: str) -> str:
    n = len(letters)
    return " ".join(letters[k % n] + letters[(k * 5 + k // n + 1) % n] + letters[(k + 2) % n] + letters[(k * 3) % n] for k in range(40))


def noise(letters: str) -> str:
    """Words with more digits and dashes than letters."""
    return " ".join(f"{w[0]}{k * 7919 + 1000}-{w[1]}" for k, w in enumerate(clean(letters).split()))


@pytest.mark.parametrize("script", SCRIPTS)
def test_letters_by_name(script):
    letters, begin = SCRIPTS[script]
    for text in (clean(letters), noise(letters)):
        n = sum(unicodedata.name(c, "").startswith(begin) for c in text)
        assert quality_rules.Features(text).letters == (n, n * (script == "en"), 0)


def test_verdicts(spark):
    rows = [(k, text(letters)) for k, (letters, _) in enumerate(SCRIPTS.values()) for text in (clean, noise)]
    rows.append((99, clean("ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
    # half of each word in a script without case: upper case is judged among the letters with a case
    rows.append((98, " ".join(a[:2] + b[:2] for a, b in zip(clean(SCRIPTS["zh"][0]).split(), clean("ABCDEFGHIJKLMNOPQRSTUVWXYZ").split(), strict=True))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["kept"]) for r in quality_rules.quality_cascade(docs).collect())
    assert got == sorted([(k, kept) for k in range(len(SCRIPTS)) for kept in (False, True)] + [(98, False), (99, False)])
