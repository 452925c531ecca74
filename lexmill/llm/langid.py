"""Problem 2: a language with a confidence for every message and each of its sentences.

Method: segmentation-marginalised unigrams. Every language has probabilities of the pieces of a fixed
public vocabulary; a word's probability is the sum over all its segmentations into pieces (forward
algorithm), a sentence's the product over its words. The probabilities are fitted by expectation
maximisation over segmentations (forward-backward) on words of labelled documents. The vocabulary has only single
letters of the Indic scripts, so runs of up to ``RUN`` of its Indic letters are pieces too.

The classifier is fitted on a bounded sample of labelled rows: ``SAMPLE`` documents a language, those of the smallest
id hash. Everything else covers all rows. Words are letters only: numbers, signs and addresses say nothing.

Null and blank content and content without words give no sentence, language ``und`` and confidence 0. Very long content is
scored whole. Repeated rows give repeated results (p2_found is distinct).
"""

from __future__ import annotations

import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.canonical import one_form
from lexmill.llm.common import TOKENIZER_DIR

LANGUAGES = ("en", "hi", "hinglish", "mr", "bn", "ta")
SAMPLE, RUN, ROUNDS, MIN_WORDS = 300, 4, 4, 2
VOCABULARY = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
#: A sentence has a language if the best one has this probability against the others.
CONFIDENT = 0.9

_WORD = regex.compile(r"[\p{L}][\p{L}\p{M}]*")
_JAVA_WORD = "\\p{L}[\\p{L}\\p{M}]*"
_CUT = re.compile(r"(?<=[.?!।])\s+|\s*[\r\n]+\s*")
_SHORT = re.compile(r"(?:^|[\s(,])(?:Rs|[Nn]os?|H\.No|Mr|Mrs|Ms|Dr|Smt|Shri|Sri|Adv|Kum|St|Cl|Art|Sec|vs|[A-Z])\.$")
_SKIP = re.compile(r"\S*(?:@|://|www\.|\.example|\.invalid|\.test|[\[(](?:at|dot)[\])])\S*", re.I)


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: cut at line ends and behind end marks that don't belong to an abbreviation."""
    out: list[str] = []
    for part in _CUT.split(text or ""):
        if not part:
            continue
        if out and _SHORT.search(out[-1]):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def pieces_of(path: str = VOCABULARY) -> frozenset[str]:
    """The vocabulary's text pieces; the sign before a word is kept."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return frozenset(p.lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)])


def _indic(c: str) -> bool:
    return "ऀ" <= c <= "෿"


class UnigramModel:
    """Piece log-probabilities of each language."""

    def __init__(self, counts: dict[str, dict[str, float]], vocabulary: frozenset[str], rounds: int = ROUNDS) -> None:
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary))
        self.log: dict[str, np.ndarray] = {}
        fitted = {}
        for lang in LANGUAGES:
            words = counts.get(lang) or {"": 1.0}
            prob: dict[str, float] = {}
            for _ in range(rounds):
                expected: dict[str, float] = defaultdict(float)
                for word, n in words.items():
                    self._expect(word, n, prob, expected)
                total = sum(expected.values()) or 1.0
                prob = {p: c / total for p, c in expected.items() if c > 1e-9}
            fitted[lang] = prob
        seen = set().union(*fitted.values())
        floor = 0.02 / (len(seen) + len(vocabulary))
        self.floor = math.log(floor)
        for p in seen:
            self.log[p] = np.log(np.array([0.98 * fitted[lang].get(p, 0.0) + floor for lang in LANGUAGES]))
        prior = np.array([sum((counts.get(lang) or {}).values()) for lang in LANGUAGES], float)
        self.missing = np.where(prior > 0, 0.0, -1e6)  # a language without labelled rows is never chosen

    def _edges(self, s: str, start: int) -> Iterator[int]:
        yield start + 1
        for end in range(start + 2, min(len(s), start + self.longest) + 1):
            p = s[start:end]
            if p in self.vocabulary or (end - start <= RUN + 1 and all(_indic(c) or c == "▁" for c in p)):
                yield end

    def _expect(self, word: str, n: float, prob: dict[str, float], expected: dict[str, float]) -> None:
        """Add the word's expected piece counts over all its segmentations."""
        s = "▁" + word
        size = len(s)
        edges = [(a, b, prob.get(s[a:b], 1e-7) if prob else 0.02 ** (1 if b - a > 1 else 1.5)) for a in range(size) for b in self._edges(s, a)]
        ahead, back = [0.0] * (size + 1), [0.0] * (size + 1)
        ahead[0] = back[size] = 1.0
        for a, b, p in edges:
            ahead[b] += ahead[a] * p
        for a, b, p in reversed(edges):
            back[a] += back[b] * p
        if ahead[size] > 0:
            for a, b, p in edges:
                expected[s[a:b]] += n * ahead[a] * p * back[b] / ahead[size]

    def word(self, word: str) -> np.ndarray:
        """Log-probability of the word in each language, summed over segmentations."""
        s = "▁" + word
        ahead = np.full((len(s) + 1, len(LANGUAGES)), -np.inf)
        ahead[0] = 0
        for a in range(len(s)):
            for b in self._edges(s, a):
                p = self.log.get(s[a:b])
                if p is None:
                    if b - a > 1:
                        continue
                    p = self.floor
                ahead[b] = np.logaddexp(ahead[b], ahead[a] + p)
        return ahead[-1]


class Scorer:
    """Scores sentences; words and sentences met before are looked up."""

    def __init__(self, model: UnigramModel) -> None:
        self.model = model
        self.words: dict[str, np.ndarray] = {}
        self.known: dict[str, tuple[str, float, int]] = {}

    def sentence(self, text: str) -> tuple[str, float, int]:
        """(language, confidence, words); language 'und' where nothing can be said."""
        found = _WORD.findall(_SKIP.sub(" ", one_form(text)))
        indic = [w for w in found if _indic(w[0])]
        if len(indic) >= 2:  # a sentence of an Indic script: its Latin words are foreign
            words = indic
        elif sum(w.isupper() for w in found) * 2 > len(found):
            words = [w.lower() for w in found]
        else:  # a capital inside the sentence marks a name
            words = found[:1] + [w for w in found[1:] if not w[0].isupper()]
            words = [w.lower() for w in words]
        words = [w for w in words if len(w) > 1 and w not in ("rs", "inr")]
        key = " ".join(words)
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
                self.words.clear()
            got = self.known[key] = self._score(words)
        return got

    def _score(self, words: list[str]) -> tuple[str, float, int]:
        if not words:
            return "und", 0.0, 0
        total = self.model.missing.copy()
        for w in words:
            s = self.words.get(w)
            if s is None:
                # one word can't outweigh a sentence: names and foreign words are bounded
                raw = self.model.word(w)
                s = self.words[w] = np.maximum(raw - raw.max(), -4.0)
            total += s
        post = np.exp(total - total.max())
        post /= post.sum()
        k = int(post.argmax())
        return LANGUAGES[k], float(post[k]), len(words)


def fit(documents: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, vocabulary: str = VOCABULARY) -> UnigramModel:
    """Fit on ``sample`` labelled documents a language. Only their word counts come to the driver."""
    labelled = documents.where(F.col(lang_col).isin(*LANGUAGES) & F.col(text_col).isNotNull())
    rank = F.row_number().over(Window.partitionBy(lang_col).orderBy(F.xxhash64(id_col), F.col(id_col)))
    ids = labelled.select(id_col, lang_col).withColumn("__rank", rank).where(F.col("__rank") <= sample).select(id_col)
    chosen = labelled.join(F.broadcast(ids), id_col, "left_semi")  # sample x languages ids
    words = chosen.select(F.col(lang_col).alias("lang"), F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(_JAVA_WORD), F.lit(0))).alias("word"))
    counts: dict[str, dict[str, float]] = defaultdict(dict)
    for lang, word, n in words.groupBy("lang", "word").agg(F.count("*").alias("n")).where(F.length("word").between(2, 40)).collect():
        counts[lang][word] = math.sqrt(n)  # damped: formulas of the genre aren't the language
    return UnigramModel(counts, pieces_of(vocabulary))


_scorers: dict[str, Scorer] = {}


def segment_languages(df: DataFrame, model: UnigramModel, key_col: str = "msg_no", text_col: str = "content") -> DataFrame:
    """(key, language, confidence, segments ARRAY<STRUCT<no, language, confidence, words>>) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary and the sample
    token = uuid.uuid4().hex
    kind = df.schema[key_col].dataType.simpleString()
    item = pa.struct([("no", pa.int32()), ("language", pa.string()), ("confidence", pa.float64()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorers.get(token)
        if scorer is None:  # the worker keeps what it has met across its tasks
            _scorers.clear()
            scorer = _scorers[token] = Scorer(shared.value)
        for b in batches:
            langs, sure, parts, ends = [], [], [], [0]
            for text in b.column(1).to_pylist():
                weight: dict[str, float] = defaultdict(float)
                words = 0
                for no, s in enumerate(sentences(text), 1):
                    lang, p, n = scorer.sentence(s)
                    parts.append((no, lang, p, n))
                    if n:
                        weight[lang] += p * n
                        words += n
                best = max(weight, key=lambda x: (weight[x], x)) if weight else "und"
                langs.append(best)
                sure.append(weight[best] / words if words else 0.0)
                ends.append(len(parts))
            cols = list(zip(*parts)) if parts else [(), (), (), ()]
            seg = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, item)], fields=list(item))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), seg)], ["key", "language", "confidence", "segments"]
            )

    rows = df.select(F.col(key_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    schema = f"key {kind}, language string, confidence double, segments array<struct<no:int,language:string,confidence:double,words:int>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key_col)


def named_language(label: Column) -> Column:
    """The language that a stored label names; null where it names none."""
    # Spellings of the six languages.
    s = F.lower(F.trim(label))
    code = F.regexp_extract(s, "^([a-z]+)", 1)
    names = {"english": "en", "eng": "en", "en": "en", "hindi": "hi", "hin": "hi", "hi": "hi", "hinglish": "hinglish", "marathi": "mr", "mar": "mr", "mr": "mr", "bengali": "bn", "bangla": "bn", "ben": "bn", "bn": "bn", "tamil": "ta", "tam": "ta", "ta": "ta"}
    return F.when(s.rlike("^hi[-_]latn"), "hinglish").otherwise(F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[code])


def unnamed_languages(messages: DataFrame, labels: DataFrame, model: UnigramModel) -> DataFrame:
    """(msg_no, lang): languages of at least one whole sentence of a user message that its label doesn't name."""
    users = messages.where("role = 'user' and msg_no is not null and content is not null")
    found = segment_languages(users.select("msg_no", "content"), model)
    sure = F.filter("segments", lambda s: (s.words >= MIN_WORDS) & (s.confidence >= CONFIDENT))
    langs = found.select("msg_no", F.explode(F.array_distinct(F.transform(sure, lambda s: s.language))).alias("lang"))
    named = labels.where("msg_no is not null").select("msg_no", named_language(F.col("language")).alias("named"))
    out = langs.join(named, "msg_no").where(~F.col("lang").eqNullSafe(F.col("named")))
    return out.select("msg_no", "lang").distinct()
