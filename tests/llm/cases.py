"""Small documents with everything that can be odd about a row, and plain Python versions of the operators."""

from __future__ import annotations

import random
import re

import xxhash

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, spans string, score string, ids string, size string, "
    "`_row` long, `_text` string, `a.b` string, component_id string, lang_pred string, copies string, n_tokens string"
)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def sentences(seed: int, count: int) -> str:
    pick = random.Random(seed)
    known = "the quick river carries seven stones past old mills while birds rest on low branches near town".split()
    return " ".join(pick.choice(known) + pick.choice(["", "", ",", "."]) for _ in range(count))


def odd_documents() -> list[tuple]:
    """Null ids and texts, empty and blank texts, a very long one, repeated rows, wide characters, clashing columns."""
    long_text = sentences(1, 60_000)
    same = sentences(2, 80)
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\r\x0b\x0c ", None, "a"), (4, "word", "en", None),
        (5, "12 34 !!", "de", "b"), (6, long_text, "en", "b"), (7, same, "en", "b"), (7, same, "en", "b"), (8, same, "fr", "c"),
        (None, same, None, "c"), (None, None, None, None), (9, same + " extra", "en", "c"), (10, "日本語 テキスト é ß ﬁ 𝔘", "ja", "c"),
        (11, "x" * 70_000, "en", "d"), (12, "Password: hunter2secret mail a@b.co 10.0.0.1", "en", "d"), (13, "▁ ▁▁ a▁b", "en", "d"),
    ]
    texts += [(100 + i, sentences(100 + i, 30 + i), ("en", "de")[i % 2], "abcd"[i % 4]) for i in range(24)]
    return [(i, t, lang, s, len(t or ""), "sp", "sc", "id", "sz", 5, "tx", "ab", "co", "lp", "cp", "nt") for i, t, lang, s in texts]


def odd_frame(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


def fingerprint(text: str | None) -> int:
    found = words(text)
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints: list[int], limit: int = 2) -> list[int]:
    """For each fingerprint the first index of its component, by comparing all pairs."""
    label = list(range(len(prints)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= limit:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(prints))]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
