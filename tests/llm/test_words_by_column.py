"""Words that are read by column are told as ``canonical`` tells them one by one."""

import random

import pyarrow as pa

from tallyhouse.llm import decontaminate as D
from tallyhouse.llm import words as W


def _words() -> list[str]:
    draw = random.Random(11)
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()] + list("«»‘’“”–—…€£°×÷¿¡ªº")
    cores = ["", "a", "A", "Tom", "TOM", "tOm", "Then", "the", "hours", "Hours", "KG", "kg", "m", "Éa", "É", "ÀB", "ßa", "Straße", "ÿ", "Þor", "Ωmega", "İx", "ﬁn", "日本", "12", "3kg", "1.5", "x1", "a-b", "don't", "ǅe", "Σας"]
    words = cores[1:] + marks + [m + c + n for c in cores for m in ("", "(", "$", "+", "-", "%", "“", "°") for n in ("", ".", ".)", "%", "$", "-", "?”", "°", ":]", "’")]
    words += ["".join(draw.choice(marks) for _ in range(draw.randrange(4))) + draw.choice(cores) + "".join(draw.choice(marks) for _ in range(draw.randrange(4))) for _ in range(6000)]
    return sorted({w for w in words if w})


def test_columns_tell_what_canonical_tells():
    words, canon = _words(), D.Canon()
    code, kind, ends, value = canon._told(pa.array(words, pa.large_string()))
    told = [D.canonical(w) for w in words]
    assert kind.tolist() == [t[1] for t in told]
    assert ends.tolist() == [t[2] for t in told]
    assert code.tolist() == W.hash_strings([t[0] for t in told]).tolist()
    assert value.tolist() == W.hash_strings([D.literal(w) if t[1] == D._SLOT else t[0] for w, t in zip(words, told, strict=True)]).tolist()
    canon.read(pa.array([], pa.large_string()))
    canon.read(pa.array(["", "  "], pa.large_string()))
    assert not len(canon.plain)


def test_common_words_are_not_told_one_by_one(monkeypatch):
    asked = []
    one = D.canonical
    monkeypatch.setattr(D, "canonical", lambda w: (asked.append(w), one(w))[1])
    D.Canon().read(pa.array(["Then Élise bought (three) kilograms of “plums”, and 12 pears. Why?"], pa.large_string()))
    assert asked == ["12"]
