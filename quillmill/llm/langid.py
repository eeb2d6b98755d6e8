"""Languages of records and of their segments: known words first, then shorter and shorter n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = ("en", "de", "fr", "es", "pt", "zh")
# The code of a record in none of these languages.
UNKNOWN = "und"
# The model is fitted on about so many labelled rows of each table at most.
SAMPLE_ROWS = 8000
# A record is of no known language if most of its words hold no known n-gram of three characters, or if it has at least so many
# words and the share of known ones is under half of what nearly all held-out records have.
UNKNOWN_WORDS, WEAK_SHARE, KNOWN_QUANTILE = 4, 0.5, 0.02
# A word is known, and an n-gram kept, from so many occurrences on.
WORD_LEAST, GRAM_LEAST = 3, 3
LONGEST_GRAM = 5
# A sentence counts as of a language of its own from so many words (or twice as many Han characters) and such a lead, in nats.
SENTENCE_WORDS, SENTENCE_LEAD = 3, 4.0
# Words remembered in each Python worker.
REMEMBERED = 200_000

# A Han character, a word of other scripts, or the end of a sentence.
TOKEN = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+|[.!?…](?=[\s\"'”’»)\]]|$)|[。！？\n|]")
_ENDS = frozenset(".!?…。！？\n|")
_FENCE = re.compile(r"(?ms)^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[ \t]*$|\Z)")
_CODE = re.compile(r"`[^`\n]+`|\$\$[^$]+\$\$|\[\[[^\]\n]*\]\]|\b\w+://\S+")
_BLOB = re.compile(r"(?=[A-Za-z+/=_-]{0,59}[0-9])[A-Za-z0-9+/=_-]{60,}")
_HEADING = re.compile(r"(?m)^[ \t]{0,3}#{1,6}[ \t].*$")
_FRONT = re.compile(r"(?s)\A\s*---\r?\n.*?\n---\r?(?:\n|\Z)")
_QUOTED = re.compile(r"[\"“„«「『][^\"“”„«»「」『』\n]{1,160}[\"”“»」』]")


def own_words(text: str) -> str:
    """A text with headings, code, encoded data, links and quoted phrases blanked out; offsets stay.

    A quotation that is a line's whole content is no phrase and stays.
    """

    def blank(m: re.Match) -> str:
        return re.sub(r"[^\n]", " ", m[0])

    def blank_quote(m: re.Match) -> str:
        line_start = text.rfind("\n", 0, m.start()) + 1
        line_end = text.find("\n", m.end())
        around = text[line_start : m.start()] + text[m.end() : line_end if line_end >= 0 else len(text)]
        return m[0] if not any(c.isalpha() for c in around) else blank(m)

    if text.lstrip()[:3] == "---":
        text = _FRONT.sub(blank, text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(blank, text)
    if "`" in text or "$$" in text or "[[" in text or "://" in text:
        text = _CODE.sub(blank, text)
    if len(text) >= 60:
        text = _BLOB.sub(blank, text)
    if "#" in text:
        text = _HEADING.sub(blank, text)
    if any(q in text for q in "\"“„«「『"):
        text = _QUOTED.sub(blank_quote, text)
    return text


class Model:
    """Log frequencies of words and n-grams for each language; how confidence follows from a lead, and the least share of known words."""

    def __init__(self, languages: tuple[str, ...], words: dict[str, list[float]], grams: dict[str, list[float]], floor: list[float]):
        self.languages, self.words, self.grams, self.floor = languages, words, grams, floor
        self.slope, self.least_known = (-1.0, 1.5), 0.0

    def confidence(self, lead):
        """The probability that the best language is right, from its lead over the second in nats."""
        import numpy as np

        return 1 / (1 + np.exp(-(self.slope[0] + self.slope[1] * np.log1p(np.maximum(0, lead)))))

    @staticmethod
    def counted(rows: list[tuple[str, str]], languages: tuple[str, ...]) -> Model:
        import math

        at = {lang: i for i, lang in enumerate(languages)}
        words: dict[str, list[int]] = defaultdict(lambda: [0] * len(languages))
        for lang, text in rows:
            for w in TOKEN.findall(own_words(text).lower()):
                if w not in _ENDS:
                    words[w][at[lang]] += 1
        grams: dict[str, list[int]] = defaultdict(lambda: [0] * len(languages))
        for w, counts in words.items():
            for g in word_grams(w):
                mine = grams[g]
                for i, c in enumerate(counts):
                    mine[i] += c

        def logs(table: dict[str, list[int]], least: int) -> tuple[dict[str, list[float]], list[float]]:
            kept = {k: c for k, c in table.items() if sum(c) >= least}
            totals = [sum(c[i] for c in table.values()) + 0.5 * (len(kept) + 1) for i in range(len(languages))]
            return (
                {k: [math.log((c[i] + 0.5) / totals[i]) for i in range(len(languages))] for k, c in kept.items()},
                [math.log(0.5 / t) for t in totals],
            )

        by_length: dict[int, dict[str, list[int]]] = defaultdict(dict)
        for g, c in grams.items():
            by_length[len(g)][g] = c
        all_grams: dict[str, list[float]] = {}
        for table in by_length.values():
            all_grams |= logs(table, GRAM_LEAST)[0]
        known, _ = logs(words, WORD_LEAST)
        return Model(languages, known, all_grams, [0.0] * len(languages))

    def vector(self, word: str) -> tuple[list[float], float, float]:
        """A word's scores: its own, else the mean of its longest n-grams that are known; whether it's known, and whether hardly a part of it is."""
        hit = self.words.get(word)
        if hit is not None:
            return hit, 1.0, 0.0
        padded = f"\x02{word}\x03"
        for n in range(LONGEST_GRAM, 0, -1):
            found = [self.grams[g] for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g in self.grams]
            if found:
                return [sum(v[i] for v in found) / len(found) for i in range(len(self.languages))], 0.0, float(n < 3)
        return self.floor, 0.0, 1.0


def word_grams(word: str) -> list[str]:
    padded = f"\x02{word}\x03"
    return [padded[i : i + n] for n in range(1, LONGEST_GRAM + 1) for i in range(len(padded) - n + 1)]


class Identifier:
    """Scores texts with a model; remembers words as rows of a matrix."""

    def __init__(self, model: Model):
        import numpy as np

        self.np, self.model = np, model
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {e: 0 for e in _ENDS}
        self.table = self.np.zeros((4096, len(self.model.languages) + 2), self.np.float32)
        self.used = 1

    def _id(self, word: str) -> int:
        if self.used == len(self.table):
            self.table = self.np.concatenate([self.table, self.np.zeros_like(self.table)])
        scores, known, weak = self.model.vector(word)
        self.table[self.used] = (*scores, known, weak)
        self.ids[word] = i = self.used
        self.used += 1
        return i

    def sentences(self, texts: list[str]) -> tuple:
        """For a list of texts: (text number, scores, number of words, known and weak words) of each sentence."""
        np = self.np
        if self.used > REMEMBERED:
            self._reset()
        ids: list[int] = []
        lens = []
        get, new = self.ids.get, self._id
        find = TOKEN.findall
        for t in texts:
            found = find(own_words(t).lower())
            for w in found:
                i = get(w)
                ids.append(new(w) if i is None else i)
            ids.append(0)
            lens.append(len(found) + 1)
        flat = np.array(ids, np.int64)
        # every end of a sentence, and of a text, closes a stretch
        ends = np.flatnonzero(flat == 0)
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        scores = np.add.reduceat(self.table[flat], starts, axis=0) if len(flat) else np.zeros((0, self.table.shape[1]))
        owner = np.repeat(np.arange(len(texts)), lens)[ends] if len(flat) else ends
        n_langs = len(self.model.languages)
        return owner, scores[:, :n_langs], ends - starts, scores[:, n_langs:]

    def judge(self, scores, n_words, known):
        """(best language, lead over the second, whether it's a sentence to count) of each sentence."""
        np = self.np
        order = np.argsort(-scores, axis=1)
        at = np.arange(len(scores))
        best = order[:, 0]
        lead = scores[at, best] - scores[at, order[:, 1]]
        said = known >= n_words * self.model.least_known
        return best, lead, (n_words >= SENTENCE_WORDS) & (lead >= SENTENCE_LEAD) & said

    def totals(self, texts: list[str | None]):
        """Of each text: scores, words by language of its sentences, number of words, known and weak words."""
        np = self.np
        n_langs = len(self.model.languages)
        owner, scores, n_words, kinds = self.sentences([t or "" for t in texts])
        best, _, counts = self.judge(scores, n_words, kinds[:, 0])
        mass, total, every = np.zeros((len(texts), n_langs)), np.zeros((len(texts), n_langs)), np.zeros((len(texts), 3))
        np.add.at(mass, (owner[counts], best[counts]), n_words[counts])
        np.add.at(total, owner, scores)
        np.add.at(every, owner, np.column_stack([n_words, kinds]))
        return total, mass, every

    def records(self, texts: list[str | None]) -> list[tuple[str | None, float, list[str]]]:
        """(language, confidence, languages of whole sentences) of each text.

        The language is that of most of the words, or ``und`` where the words are of none that is known. The confidence is the calibrated
        probability of the lead over the second language, times the language's share of the words in whole sentences.
        """
        np = self.np
        total, mass, every = self.totals(texts)
        order = np.sort(total, axis=1)
        sure = self.model.confidence(order[:, -1] - order[:, -2])
        n, known, weak = every.T
        strange = (weak > n * WEAK_SHARE) | ((n >= UNKNOWN_WORDS) & (known < n * self.model.least_known))
        out = []
        for i in range(len(texts)):
            if strange[i]:
                # the less is known, the surer
                out.append((UNKNOWN, float(1 - known[i] / n[i]), [UNKNOWN]))
            elif mass[i].any():
                b = int(mass[i].argmax())
                langs = [self.model.languages[j] for j in np.flatnonzero(mass[i])]
                share = float(mass[i][b] / mass[i].sum())
                p = float(sure[i]) if int(total[i].argmax()) == b else 0.5
                out.append((self.model.languages[b], share * p, langs))
            elif total[i].any():
                b = int(total[i].argmax())
                out.append((self.model.languages[b], float(sure[i]), [self.model.languages[b]]))
            else:
                out.append((None, 0.0, []))
        return out

    def segments(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, confidence): stretches of sentences of one language; they tile the text."""
        np = self.np
        spans, start = [], 0
        for m in TOKEN.finditer(own_words(text)):
            if m[0] in _ENDS:
                spans.append((start, m.end()))
                start = m.end()
        if start < len(text) or not spans:
            spans.append((start, len(text)))
        parts = [text[a:b] for a, b in spans]
        owner, scores, n_words, kinds = self.sentences([own_words(p) for p in parts])
        total = np.zeros((len(parts), len(self.model.languages)))
        words = np.zeros((len(parts), 2))
        np.add.at(total, owner, scores)
        np.add.at(words, owner, np.column_stack([n_words, kinds[:, 0]]))
        best, lead, counts = self.judge(total, words[:, 0], words[:, 1])
        merged: list[list] = []
        for (a, b), lang, gap, own in zip(spans, best, lead, counts, strict=True):
            if merged and (not own or merged[-1][2] in (int(lang), -1)):
                merged[-1][1] = b
                if own:
                    merged[-1][2] = int(lang)
                    merged[-1][3] = max(merged[-1][3], float(gap))
            else:
                merged.append([a, b, int(lang) if own else -1, float(gap)])
        whole = int(total.sum(axis=0).argmax())
        return [
            (a, b, self.model.languages[lang if lang >= 0 else whole], float(self.model.confidence(gap)))
            for a, b, lang, gap in merged
        ]


def label_language(col) -> F.Column:
    """The language code of a label: what stands before ``-`` or ``_``, in lower case."""
    return F.regexp_extract(F.lower(F.trim(F.coalesce(col, F.lit("")))), r"^([^-_]*)", 1)


def picked(rows: DataFrame, key, about: int, salt: str) -> DataFrame:
    """About ``about`` rows, by a hash threshold; no row but these is moved."""
    of = 1 << 40
    share = min(1.0, about / max(1, rows.count()))
    return rows.filter(F.pmod(F.xxhash64(F.lit(salt), key), F.lit(of)) < F.lit(int(of * share)))


def calibrate(model: Model, held: list[tuple[str, str]], seed: int = 5) -> None:
    """Set how confidence follows from a lead, on held-out rows and short stretches of them, and the least share of known words."""
    import random

    import numpy as np

    rnd, who = random.Random(seed), Identifier(model)
    shares = [k / n for n, k, _ in who.totals([t for _, t in held])[2] if n >= UNKNOWN_WORDS]
    if shares:
        model.least_known = float(np.quantile(shares, KNOWN_QUANTILE)) / 2
    tests = []
    for lang, text in held:
        words = [w for w in TOKEN.findall(own_words(text)) if w not in _ENDS]
        for size in (1, 2, 4, 8):
            if words:
                at = rnd.randrange(len(words))
                tests.append((lang, " ".join(words[at : at + size])))
    if not tests:
        return
    total = who.totals([t for _, t in tests])[0]
    order = np.sort(total, axis=1)
    x = np.column_stack([np.ones(len(tests)), np.log1p(np.maximum(0, order[:, -1] - order[:, -2]))])
    y = np.array([model.languages[b] == lang for b, (lang, _) in zip(total.argmax(axis=1), tests, strict=True)], float)
    w = np.array([0.0, 1.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - y) + 0.1 * w)
    model.slope = (float(w[0]), float(max(0.1, w[1])))


def fit(tables: list[DataFrame], languages: tuple[str, ...] = LANGUAGES, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from a bounded sample of labelled rows ``(key, label, text)`` of each table.

    Rows are picked by a hash of the key. Labels are of uneven quality: rows whose label the first model
    contradicts, and mixed ones, are left out of the second count, and again of the third. Of the last every fifth row is held out, to calibrate.
    """
    rows: list[tuple[str, str]] = []
    for t in tables:
        lang = label_language(F.col("label"))
        usable = picked(t, F.col("key"), sample_rows, "language").filter(lang.isin(*languages) & F.col("text").rlike(r"\p{L}{2}"))
        got = usable.select(lang.alias("lang"), "text").toArrow()
        rows += list(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    rows.sort()
    model, held = Model.counted(rows, languages), rows
    for last in (False, True):
        judged = Identifier(model).records([t for _, t in rows])
        sound = [r for r, (_, _, langs) in zip(rows, judged, strict=True) if langs == [r[0]]]
        have = Counter(lang for lang, _ in sound)
        sound = sound if all(have[lang] for lang in {r[0] for r in rows}) else rows
        held = sound[::5]
        model = Model.counted([r for i, r in enumerate(sound) if i % 5] if last and len(sound) >= 100 else sound, languages)
    calibrate(model, held)
    return model


_IDENTIFIERS: dict[int, Identifier] = {}


def identifier(broadcast) -> Identifier:
    """The worker's identifier for a broadcast model."""
    if broadcast.id not in _IDENTIFIERS:
        _IDENTIFIERS.clear()
        _IDENTIFIERS[broadcast.id] = Identifier(broadcast.value)
    return _IDENTIFIERS[broadcast.id]


class _Handle:
    """A broadcast with an id that survives pickling."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def languages(rows: DataFrame, model: Model) -> DataFrame:
    """``key, label, lang, confidence, langs, n_letters`` of rows ``(key, label, text)``; map-only.

    ``lang`` is the language of most of a record's words, ``langs`` those in which it has whole sentences.
    Headings, code, links and quoted phrases don't count. Records without a word have a null language and the confidence 0, such in no known language ``und``.
    ``n_letters`` counts the letters of the whole text.
    """
    handle = _Handle(rows.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        who = identifier(handle)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                judged = who.records(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([j[0] for j in judged], pa.string()),
                        pa.array([j[1] for j in judged], pa.float64()),
                        pa.array([j[2] for j in judged], pa.list_(pa.string())),
                        part.column(3),
                    ],
                    ["key", "label", "lang", "confidence", "langs", "n_letters"],
                )

    letters = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"\p{L}"))
    return rows.select(
        "key", label_language(F.col("label")).alias("label"), "text", letters.alias("n_letters")
    ).mapInArrow(run, "key string, label string, lang string, confidence double, langs array<string>, n_letters int")


def segments(rows: DataFrame, model: Model) -> DataFrame:
    """``key, segment, start, end, lang, confidence``: the stretches of each record in one language.

    Offsets are code points; the segments of a record tile its text. Null and empty texts give no row.
    """
    handle = _Handle(rows.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        who = identifier(handle)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                judged = who.records(texts)
                out = []
                for k, t, (lang, conf, langs) in zip(keys, texts, judged, strict=True):
                    if t:
                        parts = who.segments(t) if len(langs) > 1 else [(0, len(t), lang, conf)]
                        out += [(k, i, *p) for i, p in enumerate(parts)]
                cols = list(zip(*out, strict=True)) or [()] * 6
                types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                    ["key", "segment", "start", "end", "lang", "confidence"],
                )

    return rows.select("key", "text").mapInArrow(
        run, "key string, segment int, start int, end int, lang string, confidence double"
    )


def mislabelled(judged: DataFrame, least_letters: int = 20) -> DataFrame:
    """``key, lang``: records whose label is wrong or that are mixed, a row for each of their languages; none of unknown language."""
    wrong = (F.size("langs") > 1) | ~F.col("label").eqNullSafe(F.col("lang"))
    known = F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN)
    cases = judged.filter((F.col("n_letters") >= least_letters) & known & wrong)
    return cases.select("key", F.explode("langs").alias("lang"))
