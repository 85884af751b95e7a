"""License scan: winnowed template fingerprints, then banded alignment.

Templates are cut into word trigrams and winnowed (the smallest hash of every
window of ``window`` trigrams is a fingerprint); an inverted index maps each
fingerprint to its templates and places. It is as large as the templates, not
the corpus. Every trigram of a whole document is looked up. Hits of one template
near one diagonal make a candidate, which is aligned with the template in a band
around that diagonal; the alignment gives the matched words, their coverage of
the template and the span of the document.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.license_templates import TEMPLATES, VARIANTS

WORD = re.compile(r"[^\W_]+")
GRAM = 3
WINDOW = 2               # trigrams: shared runs of GRAM + WINDOW - 1 words always meet
BAND = 8                 # words that may be inserted or left out around a diagonal
COVERAGE = 0.8
NUMBERED = 200           # words up to which a template's numbers must all be in a match
HITS = 0.15              # share of a template's fingerprints a candidate needs
SCHEMA = ("doc_id long, license string, coverage double, matched_words long, "
          "template_words long, start_char long, end_char long")


def _mix(x: int) -> int:
    x = (x ^ (x >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 32)) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF


def _telling(words: list[str]) -> tuple[set[str], set[str], set[str]]:
    """Of a template: its numbers, the words that tell its family's licenses apart, and
    those of them that it has."""
    have = set(words)
    family = {v for k, vs in VARIANTS.items() if k in have for v in vs}
    numbers = {w for w in have if w.lstrip("v").isdigit()} if len(words) <= NUMBERED else set()
    return numbers, family, have & family


def same_license(telling: tuple[set[str], set[str], set[str]], words: list[str]) -> bool:
    """Whether a document's words have the template's numbers and exactly its variant."""
    numbers, family, own = telling
    have = set(words)
    return numbers <= have and have & family == own


class TemplateIndex:
    """Words, winnowed fingerprints and word numbers of the templates."""

    def __init__(self, templates: dict[str, str], window: int = WINDOW):
        self.names = sorted(templates)
        words = [WORD.findall(templates[n].lower()) for n in self.names]
        self.telling = [_telling(ws) for ws in words]
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.ids = [np.array([self.vocab[w] for w in ws], np.int64) for ws in words]
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.prints = []
        for t, ids in enumerate(self.ids):
            grams = self.grams(ids)
            hashes = [_mix(int(g)) for g in grams]
            chosen = set()
            for at in range(max(1, len(grams) - window + 1) if len(grams) else 0):
                part = hashes[at:at + window]
                low = min(part)                   # the rightmost smallest one
                chosen.add(at + max(i for i, h in enumerate(part) if h == low))
            for p in sorted(chosen):
                places[int(grams[p])].append((t, p))
            self.prints.append(len(chosen))
        self.codes = np.array(sorted(places), np.int64)
        self.places = [places[int(c)] for c in self.codes]

    @staticmethod
    def grams(ids: np.ndarray) -> np.ndarray:
        if len(ids) < GRAM:
            return np.empty(0, np.int64)
        return (ids[:-2] << 40) | (ids[1:-1] << 20) | ids[2:]

    def hits(self, ids: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Template -> [(diagonal, place in the document)] of all trigram hits."""
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if len(ids) < GRAM or not len(self.codes):
            return out
        whole = np.flatnonzero((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0))
        codes = (ids[whole] << 40) | (ids[whole + 1] << 20) | ids[whole + 2]
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        for k in np.flatnonzero(self.codes[at] == codes):
            for t, p in self.places[at[k]]:
                out[t].append((int(whole[k]) - p, int(whole[k])))
        return out


def banded_alignment(template: np.ndarray, doc: np.ndarray, diagonal: int,
                     band: int = BAND) -> tuple[int, int, int]:
    """Matched words and the document span [first, last] of the best alignment of
    the template within ``band`` of ``diagonal`` (document place - template place).

    The longest common subsequence in the band; of equal ones the shortest span.
    (0, -1, -1) if nothing matches.
    """
    width = 2 * band + 1
    end = (0, 0, -1)                              # (matched, first, last)
    last = [end] * (width + 1)
    n = len(doc)
    for i, word in enumerate(template):
        row: list[tuple[int, int, int]] = []
        for j in range(width):
            d = i + diagonal - band + j
            skip_t = last[j + 1]                  # template word left out: column to the right
            skip_d = row[j - 1] if j else (0, 0, -1)
            cell = _better(skip_t, skip_d)
            if 0 <= d < n and doc[d] == word:
                m, first, _ = last[j]
                cell = _better(cell, (m + 1, d if m == 0 else first, d))
            row.append(cell)
        last = [*row, (0, 0, -1)]
        for cell in row:
            end = _better(end, cell)
    return end[0], (end[1] if end[0] else -1), end[2]


def _better(a: tuple, b: tuple) -> tuple:
    if a[0] != b[0]:
        return a if a[0] > b[0] else b
    return a if a[2] - a[1] <= b[2] - b[1] else b


def scan_text(text: str, index: TemplateIndex, coverage: float = COVERAGE) -> list[tuple]:
    """(template, coverage, matched, template words, start, end) of a text.

    Where matches overlap, the one with the most matched less missing words stays.
    """
    lower = text.lower()
    if len(lower) != len(text):      # places are those of the text: what lowers to several stays
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = WORD.findall(lower)
    get = index.vocab.get
    ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
    hits = index.hits(ids)
    found = []
    for t, places in sorted(hits.items()):
        size, need = len(index.ids[t]), max(1, int(HITS * index.prints[t]))
        band = min(BAND, max(1, size // 4))
        places.sort()
        i = 0
        while i < len(places):                    # hits within the band of one diagonal
            k = i
            while k < len(places) and places[k][0] <= places[i][0] + band:
                k += 1
            group, i = places[i:k], k
            while len(group) >= need:             # the notice may occur more than once
                m, first, last = banded_alignment(index.ids[t], ids, group[len(group) // 2][0], band)
                if m < coverage * size:
                    break
                if same_license(index.telling[t], words[first:last + 1]):
                    found.append((size - 2 * m, first, last, t, m))
                group = [h for h in group if not first <= h[1] <= last]
    if not found:
        return []
    spans = [x.span() for x in WORD.finditer(lower)]
    taken: list[tuple[int, int]] = []
    out = []
    for _, first, last, t, m in sorted(found):
        at = bisect_left(taken, (first, last))
        if (at < len(taken) and taken[at][0] <= last) or (at and taken[at - 1][1] >= first):
            continue
        taken.insert(at, (first, last))
        size = len(index.ids[t])
        out.append((index.names[t], m / size, m, size, spans[first][0], spans[last][1]))
    return sorted(out, key=lambda x: x[4])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, str] | DataFrame | None = None,
                  coverage: float = COVERAGE) -> DataFrame:
    """One row per license found: doc_id, license, coverage, matched_words,
    template_words, start_char and end_char (0-based code points of the lower-cased
    text, end exclusive).

    ``templates`` are names and texts, as a dictionary or a table with the columns
    license and text (whole license bodies, too; it is read by the driver). A
    match must have the version numbers of a template of up to ``NUMBERED`` words and
    its variant (``VARIANTS``). Words are runs of letters and digits, lower-cased. Null and empty texts have
    no licenses; repeated rows are reported as often as they occur; a null
    doc_id stays null; empty tables give an empty result; other columns are
    ignored. Whole texts are scanned in one pass without a shuffle.
    """
    if isinstance(templates, DataFrame):
        templates = {r["license"]: r["text"] for r in templates.select("license", "text").collect()}
    chosen = dict(templates if templates is not None else TEMPLATES)

    def run(batches):
        index = TemplateIndex(chosen)
        for b in batches:
            rows = [(i.as_py(), *r) for i, t in zip(b.column(0), b.column(1)) if t.is_valid
                    for r in scan_text(t.as_py(), index, coverage)]
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.float64()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, ty) for c, ty in zip(cols, types)],
                [x.split()[0] for x in SCHEMA.split(", ")])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return d.mapInArrow(run, SCHEMA)
