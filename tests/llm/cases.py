"""Small documents with everything that may be odd about a row."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, copies int, gone string, g long"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
EN = "the of and to in that is was for on with as by at from this have not are but river stone house garden winter letter market silver window morning".split()
DE = "der die und das ist nicht ein eine auf mit von dem den zu für über schön straße fluss haus garten winter brief markt silber fenster morgen größe".split()


def sentence(chance: random.Random, words: list[str], n: int) -> str:
    return " ".join(chance.choice(words) for _ in range(n))


def row(doc_id, text, lang="en", source="a"):
    """A row with extra columns whose names the operators use themselves."""
    return (doc_id, text, lang, source, None if text is None else len(text), 0.5, 7, "x", 1)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, one very long text, repeated rows, a repeated id."""
    chance = random.Random(5)
    long = sentence(chance, EN, 60_000)
    same = sentence(chance, EN, 40)
    return [
        row(1, None), row(2, ""), row(3, " \t\n\x0b "), row(4, "one"), row(5, "one"), row(6, long), row(7, same), row(7, same), row(8, same.upper()),
        row(9, sentence(chance, DE, 50), "de", None), row(10, sentence(chance, DE, 50), None, "b"), row(7, "another text under the same id here"), row(None, same, "en", "b"), row(11, "ÅÄÖ 漢字   ...", "de", "b"), row(12, "12 34 -- 56"),
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
