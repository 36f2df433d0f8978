"""Problem 4: defective answers, found by tagging their clauses with a conditional random field."""

from __future__ import annotations

import hashlib
import io
import random
import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Container, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark import runtime
from quillspark.llm import bits

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
SAMPLE = 4000  # rows the field is fitted on: those of lowest hash of resp_id; a bound of the fit, not of what is tagged
SAMPLE_CHARS = 8000  # characters of a message that the fit looks at
BUCKETS = 1 << 16
REPEATED = 3  # different questions that share an answer's clause, from which it counts as repeated
INTRO, INTRO_SHARE = 30, 1.0  # letters and digits that a copy may be introduced by: so many, or this share of the question's
MISSING_WORDS, MISSING_SHARE = 8, 0.25  # last words that a copy may lack: so many, or this share of the question's

#: Names of roles.
USER, ASSISTANT = frozenset(["user", "human"]), frozenset(["assistant", "gpt", "model", "bot"])
#: Common wording that declines. It only starts the labels of the fit; no answer is held against it.
SEEDS = re.compile(
    r"\b(?:i|we) (?:can(?:'|no)?t|cannot|am (?:not able|unable)|must decline|won't|will not) ?(?:be )?(?:to )?(?:help|assist|answer|go|writ|do|provide|discuss)"
    r"|\b(?:i|we) must decline\b|\bagainst my guidelines\b|\bnicht helfen\b|\bmuss (?:ich )?ablehnen\b|\bnicht beantworten\b|\bdois refuser\b|\bpeux pas (?:répondre|vous aider)\b|\bno puedo (?:ayudar|responder)\b|\bdebo rechazar\b"
    r"|не могу (?:помочь|ответить)|无法(?:回答|提供)|不能(?:回答|协助)",
    re.IGNORECASE,
)
#: Small words that one language has alone among those told apart.
WORDS = {
    "en": "the of and to is that it for with are be this by was not an from we which what how when has have before but only after does you your i my at on",
    "de": "der das und ist nicht ein eine den dem des mit von zu bei im auf für sich dass wird als aber nach warum ich sie wie zur zum unter wenn auch noch",
    "fr": "le les du et est une pour dans sur par avec plus ce pas ne au aux pourquoi mais je vous nous cette après sous il être avons",
    "es": "el los del y por para con una que su más lo sin tras qué muy como pero este esta después bajo hay cuando cuántas en",
}
_WORD_LANG = {w: k for k, ws in WORDS.items() for w in ws.split() if sum(w in v.split() for v in WORDS.values()) == 1}
#: Names of languages in these languages.
ASKED = {
    "en": r"english|englisch\w*|anglais|inglés|английск\w*|по-английски|英文|英语",
    "de": r"german|deutsch\w*|allemand|alemán|немецк\w*|по-немецки|德文|德语",
    "fr": r"french|französisch\w*|français|francés|французск\w*|по-французски|法文|法语",
    "es": r"spanish|spanisch\w*|espagnol|español|castellano|испанск\w*|по-испански|西班牙[文语]",
    "ru": r"russian|russisch\w*|russe|ruso|русск\w*|по-русски|俄[文语]",
    "zh": r"chinese|chinesisch\w*|chinois|chino|китайск\w*|по-китайски|中文|汉语",
    "ja": r"japanese|japanisch\w*|japonais|japonés|японск\w*|по-японски|日[文语]|日本語",
    "ko": r"korean|koreanisch\w*|coréen|coreano|корейск\w*|по-корейски|韩[文语]",
    "ar": r"arabic|arabisch\w*|arabe|árabe|арабск\w*|по-арабски|阿拉伯[文语]",
}
#: Scripts that stand for a language, as ranges of code points. Ideographs beside kana are Japanese.
SCRIPTS = (
    (0x0370, 0x03FF, "el"), (0x0400, 0x04FF, "ru"), (0x0530, 0x058F, "hy"), (0x0590, 0x05FF, "he"), (0x0600, 0x06FF, "ar"), (0x0900, 0x097F, "hi"), (0x0980, 0x09FF, "bn"), (0x0B80, 0x0BFF, "ta"), (0x0E00, 0x0E7F, "th"),
    (0x10A0, 0x10FF, "ka"), (0x1100, 0x11FF, "ko"), (0x3040, 0x30FF, "ja"), (0x3400, 0x9FFF, "zh"), (0xAC00, 0xD7AF, "ko"),
)
_SCRIPT_FROM = [a for a, _, _ in SCRIPTS]
_ASKED_STEMS = tuple("japan|japon|япон|日|korea|corea|coré|корей|韩|arab|árab|араб|阿拉|engl|angl|inglés|англи|英|germ|deutsch|allem|alem|немец|德|fren|franz|fran|французск|法|spani|espa|castell|испан|西班|russ|ruso|русск|俄|chin|китай|中文|汉语".split("|"))
_ASCII_STEMS = tuple(x for x in _ASKED_STEMS if x.isascii())
_ASKED = {k: re.compile(rf"(?<![a-zа-я])(?:{v})", re.IGNORECASE) for k, v in ASKED.items()}
UNSPACED = frozenset(["zh", "ja", "th"])
_TOKENS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_WORD = re.compile(r"[^\W\d_]+")
_UNIT = re.compile(r"[\u3400-\u9fff]|[^\W\d_\u3400-\u9fff]+")  # words, and each ideograph on its own
_WORD_OR_NUMBER = re.compile(r"[^\W\d_]+|\d+")
_CUT = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。？！])")
_MARK = re.compile(r"\s*(?:\d{1,2}[.)]|[-*•])\s*$")
_LISTED = re.compile(r"(?:\d{1,2}[.)]|[-*•])\s")
_FENCE = re.compile(r"(```.*?```|```.*\Z)", re.DOTALL)
_DROP = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d+")
_SAYS = re.compile(r"[^\W_]")
_END = re.compile(r"[.!?。？！…][\"'”»)\]*]*$|```$")
_STOPS, _CLOSERS = frozenset(".!?。？！…"), "\"'”»)]*"
# ASCII texts are taken apart by tables of bytes, which is much faster than by patterns: what isn't in a table's text is a space
_ABC, _NUM = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _table(letters: str, digits: str, nul: str = " ") -> bytes:
    to = {**dict(zip(_ABC, letters)), **dict(zip(_ABC.upper(), letters)), **dict(zip(_NUM, digits)), "\x00": nul}
    return "".join(to.get(chr(i), " ") for i in range(128)).encode() + b" " * 128


_LETTERS, _SAID, _LINES, _KINDS = _table(_ABC, " " * 10), _table(_ABC, _NUM, "\n"), _table(_ABC, "0" * 10, "\n"), _table("a" * 26, "0" * 10)
_SILENT = bytes(i for i in range(128) if not chr(i).isalnum())
_SILENT_BUT_NUL = _SILENT.replace(b"\x00", b"")
_ODD_SPACE = b"\t\r\f\v\x1c\x1d\x1e\x1f"
_BETWEEN = re.compile(rb"(?<=[a-z])(?=0)|(?<=0)(?=[a-z])")


@lru_cache(maxsize=1024)
def canon(text: str) -> str:
    """Letters and digits of a text, without case."""
    if text.isascii():
        return text.encode().translate(_SAID, _SILENT).decode()
    return _DROP.sub("", text.casefold())


@lru_cache(maxsize=65_536)
def script_language(w: str) -> str | None:
    """The language that a word's script stands for, by its first letter; a word with kana is Japanese. None for Latin and for
    scripts of many languages."""
    n = ord(w[0])
    if n < 0x0370:
        return None
    i = bisect_right(_SCRIPT_FROM, n) - 1
    k = SCRIPTS[i][2] if i >= 0 and n <= SCRIPTS[i][1] else None
    return "ja" if k == "zh" and any("\u3040" <= c <= "\u30ff" for c in w) else k


class _WordLanguages(dict[str, "str | None"]):
    """Language that each word seen is evidence of, as a small word or by its script."""

    def __missing__(self, w: str) -> str | None:
        if len(self) > 500_000:
            self.clear()
        got = self[w] = _WORD_LANG.get(w) or script_language(w)
        return got


_word_languages = _WordLanguages()


def language_hits(text: str) -> Counter[str]:
    """Evidence of each language in a text: small words for Latin script, words or signs for the others."""
    if text.isascii():
        return Counter(filter(None, map(_WORD_LANG.get, text.encode().translate(_LETTERS).decode().split())))
    words = _WORD.findall(text.lower())
    told = [_word_languages[w] for w in words]
    hits = Counter(filter(None, told))
    for k in UNSPACED.intersection(hits):
        hits[k] = sum([len(w) for w, x in zip(words, told) if x == k])
    if "ja" in hits and "zh" in hits:
        hits["ja"] += hits.pop("zh")
    return hits


@lru_cache(maxsize=1024)
def allowed_languages(question: str) -> set[str]:
    """Languages of the question (all with a third of the strongest evidence) and those it asks for; empty: any."""
    prose = _FENCE.sub(" ", question) if "```" in question else question
    hits = language_hits(prose)
    top = max(hits.values(), default=0)
    out = set(hits) if len(hits) < 2 else {k for k, n in hits.items() if n * 3 >= top}
    low = prose.lower()
    if out:
        for x in _ASCII_STEMS if low.isascii() else _ASKED_STEMS:
            if x in low:
                out |= {k for k, p in _ASKED.items() if p.search(prose)}
                break
    return out


def _pieces(part: str) -> list[str]:
    """A text cut by _CUT, ends stripped, nothing empty. ASCII texts without odd white space are cut at line ends put behind full stops."""
    if not part.isascii() or len(part.encode().translate(None, _ODD_SPACE)) < len(part):
        return [x for x in map(str.strip, _CUT.split(part)) if x]
    return [x for x in map(str.strip, part.replace(". ", ".\n").replace("! ", "!\n").replace("? ", "?\n").split("\n")) if x]


def clauses(answer: str) -> list[str]:
    """Sentences and lines of an answer; a code fence is one clause; a list mark belongs to what follows it."""
    out: list[str] = []
    for part in _FENCE.split(answer) if "```" in answer else [answer]:
        if part.startswith("```"):
            out.append(part)
            continue
        mark = ""
        for s in _pieces(part):
            if len(s) < 8 and _MARK.fullmatch(s) and (out or mark):
                mark = (mark + " " + s).strip()
            else:
                out.append((mark + " " + s).strip() if mark else s)
                mark = ""
        if mark:
            out.append(mark)
    return out


def split_trace(answer: str) -> tuple[str, bool]:
    """(answer without its reasoning trace, whether a trace was never closed)."""
    if "</think>" in answer:
        return answer.rpartition("</think>")[2].strip(), False
    if "<think>" in answer:
        return answer.partition("<think>")[0].strip(), True
    return answer.strip(), False


def question_and_answer(conversation: object) -> tuple[str, str | None]:
    """(last user message, what assistants say after it); None if no assistant does. Null contents are empty."""
    roles = [((m or {}).get("role") or "").strip().lower() for m in conversation] if conversation is not None else []
    last = max((i for i, r in enumerate(roles) if r in USER), default=-1)
    texts = [(conversation[i] or {}).get("content") or "" for i in range(len(roles)) if i > last and roles[i] in ASSISTANT]
    return ((conversation[last] or {}).get("content") or "") if last >= 0 else "", "\n".join(texts) if texts else None


def turns(rows: DataFrame) -> DataFrame:
    """(resp_id, q, a, finish_reason): question_and_answer of each row, taken in the JVM so that only two texts go to Python."""
    names = F.transform("conversations", lambda m: F.lower(F.regexp_replace(F.coalesce(m["role"], F.lit("")), r"(?U)^\s+|\s+$", "")))
    got = rows.select("resp_id", "conversations", "finish_reason", names.alias("_r"))
    got = got.withColumn("_l", F.array_max(F.transform("_r", lambda r, i: F.when(r.isin(*USER), i).otherwise(-1))))
    said = F.transform("conversations", lambda m, i: F.when((i > F.col("_l")) & F.get("_r", i).isin(*ASSISTANT), F.coalesce(m["content"], F.lit(""))))
    said = F.filter(said, lambda x: x.isNotNull())
    q = F.when(F.col("_l") >= 0, F.coalesce(F.get("conversations", F.col("_l"))["content"], F.lit(""))).otherwise("")
    return got.select("resp_id", q.alias("q"), F.when(F.size(said) > 0, F.array_join(said, "\n")).alias("a"), "finish_reason")


_buckets: dict[str, int] = {}


def _bucket(name: str) -> int:
    b = _buckets.get(name)
    if b is None:
        if len(_buckets) > 500_000:
            _buckets.clear()
        b = _buckets[name] = zlib.crc32(name.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)
    return b


class _WordBuckets(dict[str, int]):
    """Bucket of each word seen, all numbers sharing one."""

    def __missing__(self, t: str) -> int:
        if len(self) > 500_000:
            self.clear()
        digit = t[0].isdigit()
        got = _bucket("w0") if digit else _bucket("w" + t)
        if not digit or len(t) < 5:
            self[t] = got
        return got


_word_buckets = _WordBuckets()


class _All:
    """A vocabulary that holds every word."""

    def __contains__(self, w: object) -> bool:
        return True


def asked(parts: list[str]) -> str | None:
    """The word that an answer without a full stop ends with; None if it has one, or ends with no word."""
    if not parts or parts[-1].startswith("```") or _stopped(parts[-1], len(parts) == 1):
        return None
    toks = _TOKENS.findall(parts[-1].lower())
    return _UNIT.findall(toks[-1])[-1] if toks and toks[-1].isalpha() else None


def counted(body: str, parts: list[str]) -> set[str]:
    """Words that an answer gives to the vocabulary: all but a last one without a full stop, which may be cut."""
    words = body.encode().translate(_LETTERS).decode().split() if body.isascii() else _UNIT.findall(body.lower())
    return set(words[:-1] if asked(parts) is not None else words)


def _stopped(s: str, alone: bool) -> bool:
    s = s.removesuffix("\n")
    return (s.rstrip(_CLOSERS)[-1:] in _STOPS or s.endswith("```")) and (alone or not _MARK.fullmatch(s))


def _ending(s: str, alone: bool, known: Container[str]) -> list[str]:
    """Features of how the last clause ends."""
    mark = not alone and bool(_MARK.fullmatch(s))
    if _stopped(s, alone):
        return ["last", "stop"]
    t = [("0" if x[0].isdigit() else x) for x in _TOKENS.findall(s.lower())[-3:]]
    f = ["last", "nostop", "e1" + t[-1] if t else "e1", "e2" + " ".join(t[-2:]), "e3" + " ".join(t[-3:])]
    if t and t[-1].isalpha() and _UNIT.findall(t[-1])[-1] not in known:
        f.append("e_unknown")
    if mark:
        f.append("e_mark")
    if s.count("(") > s.count(")") or s.count("{") > s.count("}") or s.count("[") > s.count("]") or s.count('"') % 2 or s.count("$") % 2:
        f.append("e_open")
    return f


def clause_words(s: str) -> list[str]:
    return _WORD_OR_NUMBER.findall(s.casefold())


def said(parts: list[str]) -> tuple[list[list[str]], bytes | None]:
    """Words of each clause, and what said_letters needs of them. ASCII clauses are taken together, their numbers told as 0."""
    text = "\x00".join(parts)
    if not text.isascii() or text.count("\x00") >= len(parts):
        return [clause_words(s) for s in parts], None
    raw = text.encode()
    low = raw.translate(_LINES)
    while b"00" in low:
        low = low.replace(b"00", b"0")
    kinds = low.translate(_KINDS)
    if b"a0" in kinds or b"0a" in kinds:
        low = _BETWEEN.sub(b" ", low)
    return [x.split() for x in low.decode().split("\n")], raw


def said_letters(words: list[list[str]], raw: bytes | None) -> list[str]:
    """Canon of each clause."""
    return ["".join(w) for w in words] if raw is None else raw.translate(_SAID, _SILENT_BUT_NUL).decode().split("\n")


def said_keys(words: list[list[str]], raw: bytes | None) -> list[str]:
    """Key of each clause."""
    return [_key_of(w) for w in words] if raw is None else [" ".join(w) for w in words]


def clause_key(s: str) -> str:
    """A clause with numbers as one and without signs, as it is counted over all answers."""
    return _key_of(clause_words(s))


def clause_keys(parts: list[str]) -> list[str]:
    plain = [s for s in parts if s.isascii() and "\x00" not in s]
    keys = iter(said_keys(*said(plain)))
    return [next(keys) if s.isascii() and "\x00" not in s else clause_key(s) for s in parts]


def _key_of(words: list[str]) -> str:
    return _DIGITS.sub("0", " ".join(words))


@lru_cache(maxsize=4096)
def _about(question: str) -> frozenset[str]:
    """The question's words that say what it is about: four letters or more, small words aside."""
    words = question.encode().translate(_LETTERS).decode().split() if question.isascii() else clause_words(question)
    return frozenset([w for w in words if len(w) > 3 and w[0] > "9" and w not in _WORD_LANG])


@lru_cache(maxsize=4096)
def _shapes(long: int, ratio: int, count: int) -> list[list[int]]:
    """Buckets of what sets answers apart that say nothing about the question, for answers of one length, length against the
    question's and number of clauses: by 8 * words shared (0 for no word that says anything) + 4 * repeated + 2 * prose + quoted."""
    out = []
    for shared in ("s-", "s0", "s1", "s2"):
        for again in ("once", "again"):
            for prose in ("n", "p"):
                for quote in ("", "q"):
                    out.append([_bucket(x) for x in (shared, again, again + shared + prose + quote, f"{again}{shared}{prose}R{ratio}", f"{shared}{prose}L{long}", f"{again}{prose}N{count}")])
    return out


def features(
    parts: list[str], question: str, allowed: set[str], known: Container[str], repeated: Sequence[bool], size_of: tuple[int, int] | None = None, words: tuple[list[list[str]], bytes | None] | None = None
) -> tuple[list[list[int]], list[int], list[bool]]:
    """Features of each clause (bucket numbers), its weight in letters and digits (an ideograph has the weight of
    three), and whether it is prose of a known language. repeated tells which clauses answers to many questions share;
    size_of gives the answer's characters and clauses where parts are its last ones only; words is said(parts) if known.

    Beside words: how the clause ends, whether it echoes the question, its language (the answer's where its own is unclear), and what
    sets answers apart that say nothing about the question: the words it shares with it, whether it is repeated, and the
    answer's length against the question's.
    """
    cq, about = canon(question), _about(question)
    long_q = len(cq)
    out, sizes, told = [], [], []
    n = len(parts)
    bucket, small = _bucket, _WORD_LANG
    words = said(parts) if words is None else words
    letters = said_letters(*words)
    long, count = size_of or (sum(map(len, parts)), n)
    shapes, lead = _shapes(min(12, long.bit_length()), min(3, max(-3, long.bit_length() - len(question).bit_length())), min(count, 5)), intro(cq)
    new, echoed = bucket("new"), bucket("echo")
    base, first, near, far = bucket("b"), bucket("first"), bucket("near"), bucket("far")
    each: list[dict[str, int]] = []
    total: dict[str, int] = {}
    get, each_bucket = small.get, _word_buckets
    for i, (s, toks, c) in enumerate(zip(parts, words[0], letters)):
        size = len(c)
        f = [base, first] if i == 0 else [base]
        echo = size >= 6 and long_q > 0 and (c[-12:] in cq and (c in cq or size > 12 and c[-max(12, size - INTRO) :] in cq) or long_q <= size <= long_q + lead and cq in c)
        hits: dict[str, int] = {}
        if s.startswith("```"):
            f.append(bucket("code" if len(s) > 5 and s.endswith("```") else "open"))
            if i == n - 1:
                f += [bucket(x) for x in (("last", "stop") if len(s) > 5 and s.endswith("```") else ("last", "nostop", "e_open"))]
        else:
            f += [each_bucket[t] for t in toks]
            for k in (langs := list(filter(None, map(get, toks)))):
                if k not in hits:
                    hits[k] = langs.count(k)
                    if hits[k] == len(langs):
                        break
            if not s.isascii():
                for t in toks:
                    k = _word_languages[t] if t not in small else None
                    if k in UNSPACED:
                        hits[k] = hits.get(k, 0) + len(t)
                        size += 2 * len(t)
                        f += [bucket("w" + t[x : x + 2]) for x in range(len(t) - 1)]
                    elif k is not None:
                        hits[k] = hits.get(k, 0) + 1
            content = False
            for t in toks:
                if len(t) > 3 and t[0] > "9" and t not in small:
                    content = True
                    break
            shared = len(about.intersection(toks)) if content else 0
            if "ja" in hits and "zh" in hits:
                hits["ja"] += hits.pop("zh")
            for k, m in hits.items():
                total[k] = total.get(k, 0) + m
            if i == n - 1:
                f += [bucket(x) for x in _ending(s, n == 1, known)]
            f += shapes[(8 * min(3, shared + 1) if content else 0) + (4 if repeated[i] else 0) + (2 if hits or content else 0) + ('"' in s)]
        f.append(echoed if echo else new)
        out.append(f)
        sizes.append(size)
        each.append({} if echo else hits)
    main = max(total, key=total.__getitem__) if total else None
    for f, hits in zip(out, each):
        told.append(bool(hits))
        if hits:
            best = max(hits, key=hits.__getitem__) if len(hits) > 1 else next(iter(hits))
            lang = best if best == main or hits[best] >= max(3, 2 * hits.get(main, 0)) else main
            f.append(far if allowed and lang not in allowed else near)
    return out, sizes, told


def _sums(emit: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of emit over each clause's features: flat has those of all clauses, size their numbers."""
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    return np.add.reduceat(emit[flat], start, axis=0) if len(flat) else np.zeros((0, len(LABELS)))


@dataclass
class Field:
    """A linear-chain conditional random field over hashed features."""

    emit: np.ndarray
    move: np.ndarray
    known: frozenset[str]
    repeated: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.uint64))  # bit map of repeated clauses of the rows it was fitted on

    def scores(self, feats: list[list[int]]) -> np.ndarray:
        size = np.fromiter(map(len, feats), dtype=np.int64, count=len(feats))
        return _sums(self.emit, np.fromiter(chain.from_iterable(feats), dtype=np.int64, count=int(size.sum())), size)

    def row_scores(self, rows: list[list[list[int]]]) -> list[np.ndarray]:
        """Scores of each row's clauses."""
        e = self.scores([f for r in rows for f in r])
        ends = np.cumsum([len(r) for r in rows]).tolist()
        return [e[b - len(r) : b] for r, b in zip(rows, ends)]

    def decode(self, rows: list[list[list[int]]]) -> list[np.ndarray]:
        """Best labels of each row."""
        return self.best(self.row_scores(rows))

    def best(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each row (Viterbi) by its scores, rows of like length side by side."""
        out: list[np.ndarray] = [np.empty(0, dtype=int)] * len(rows)
        order = sorted((i for i in range(len(rows)) if len(rows[i])), key=lambda i: len(rows[i]))
        for k in range(0, len(order), 256):
            part = order[k : k + 256]
            n = np.array([len(rows[i]) for i in part])
            t = int(n.max())
            x = np.zeros((len(part), t, len(LABELS)))
            x[np.arange(t)[None, :] < n[:, None]] = np.concatenate([rows[i] for i in part])
            best, back = x[:, 0], np.zeros((len(part), t, len(LABELS)), dtype=np.int8)
            for j in range(1, t):
                s = best[:, :, None] + self.move[None]
                back[:, j] = s.argmax(1)
                step = s.max(1) + x[:, j]
                live = (n > j)[:, None]
                best = np.where(live, step, best)
            lab = np.zeros((len(part), t), dtype=int)
            cur = best.argmax(1)
            for j in range(t - 1, -1, -1):
                lab[:, j] = cur
                cur = np.where(n > j, back[np.arange(len(part)), j, cur], cur) if j else cur
            for r, i in enumerate(part):
                out[i] = lab[r, : n[r]]
        return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def fit_field(rows: list[tuple[list[list[int]], list[int]]], known: frozenset[str], epochs: int = 5, rate: float = 0.3, decay: float = 1e-6, seed: int = 1) -> Field:
    """Fits the field to labelled rows by its conditional likelihood: forward and backward sums, Adagrad steps."""
    k = len(LABELS)
    emit, move = np.zeros((BUCKETS, k)), np.zeros((k, k))
    ge, gm = np.full((BUCKETS, k), 1e-2), np.full((k, k), 1e-2)
    rng = random.Random(seed)
    rows = [r for r in rows if r[0]]
    flats = [np.fromiter(chain.from_iterable(f), dtype=np.int64, count=sum(map(len, f))) for f, _ in rows]
    counts = [np.fromiter(map(len, f), dtype=np.int64, count=len(f)) for f, _ in rows]
    golds = [np.array(y) for _, y in rows]
    columns = np.arange(k)
    for _ in range(epochs):
        order = sorted(range(len(rows)), key=lambda i: (min(len(rows[i][0]) // 4, 12), rng.random()))
        batches = [order[i : i + 64] for i in range(0, len(order), 64)]
        rng.shuffle(batches)
        for part in batches:
            flat, size = np.concatenate([flats[i] for i in part]), np.concatenate([counts[i] for i in part])
            e = _sums(emit, flat, size)
            n = np.array([len(rows[i][0]) for i in part])
            b, t = len(part), int(n.max())
            on = np.arange(t)[None, :] < n[:, None]
            x = np.zeros((b, t, k))
            x[on] = e
            a = np.zeros((b, t, k))
            a[:, 0] = x[:, 0]
            for j in range(1, t):
                a[:, j] = np.where(on[:, j, None], _lse(a[:, j - 1, :, None] + move[None], 1) + x[:, j], a[:, j - 1])
            z = _lse(a[:, -1], 1)
            w = np.zeros((b, t, k))
            for j in range(t - 2, -1, -1):
                w[:, j] = np.where(on[:, j + 1, None], _lse(move[None] + (x[:, j + 1] + w[:, j + 1])[:, None, :], 2), 0.0)
            p = np.exp(a + w - z[:, None, None])[on]
            gold = np.concatenate([golds[i] for i in part])
            p[np.arange(len(p)), gold] -= 1
            uniq, inv = np.unique(flat, return_inverse=True)
            g = np.bincount((inv[:, None] * k + columns).ravel(), np.repeat(p, size, axis=0).ravel(), len(uniq) * k).reshape(-1, k)
            g = g / b + decay * emit[uniq]
            ge[uniq] += g * g
            emit[uniq] -= rate * g / np.sqrt(ge[uniq])
            gt = np.zeros((k, k))
            for j in range(1, t):
                live = on[:, j]
                if live.any():
                    pair = a[live, j - 1, :, None] + move[None] + (x[live, j] + w[live, j])[:, None, :] - z[live, None, None]
                    gt += np.exp(pair).sum(0)
            np.subtract.at(gt, (np.concatenate([golds[i][:-1] for i in part]), np.concatenate([golds[i][1:] for i in part])), 1)
            gt /= b
            gm += gt * gt
            move -= rate * gt / np.sqrt(gm)
    return Field(emit, move, known)


def _masked(s: str) -> str:
    return re.sub(r"\d+", "0", s.strip())


def _word_key(w: str) -> str:
    return "w" + w


def _end_key(s: str) -> str:
    return "e" + _masked(s)


def _hashes(keys: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(keys, dtype=object), categorize=False).view(np.int64)


def _clause_hashes(keys: list[str]) -> np.ndarray:
    return _hashes(["c" + k for k in keys]) if keys else np.empty(0, dtype=np.int64)


def vocabulary(rows: DataFrame) -> DataFrame:
    """(key, n, asked): hashes of all answers' words (counted), of their endings without a full stop, and of their clauses, with the numbers
    of answers that have them. asked has one of 64 bits for each question that a clause answers, 0 for words and endings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        ends: Counter[str] = Counter()

        def counts() -> pd.DataFrame:
            got = pd.DataFrame({"key": _hashes([*map(_word_key, n), *ends]), "n": [*n.values(), *ends.values()], "asked": 0})
            n.clear()
            ends.clear()
            return got

        for pdf in batches:
            keys: list[str] = []
            bit: list[int] = []
            for a, q in zip(pdf["a"], pdf["q"]):
                body, open_trace = split_trace(a) if a is not None else ("", True)
                parts = [] if open_trace else clauses(body)
                if parts:
                    words = said(parts)
                    if words[1] is not None:
                        own = set(chain.from_iterable(words[0]))
                        own.discard("0")
                        last = asked(parts)
                        if last is not None and sum(w.count(last) for w in words[0]) == 1:
                            own.discard(last)
                        n.update(own)
                    else:
                        n.update(counted(body, parts))
                    if not _stopped(parts[-1], False):
                        ends[_end_key(parts[-1])] += 1
                    keys += said_keys(*words)
                    bit += [1 << (int(q) & 63)] * len(parts)
            h = _clause_hashes(keys)
            order = np.argsort(h, kind="stable")
            h, b = h[order], np.array(bit, dtype=np.uint64)[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
            if len(first):
                yield pd.DataFrame({"key": h[first], "n": np.diff(np.append(first, len(h))), "asked": np.bitwise_or.reduceat(b, first).view(np.int64)})
            if len(n) + len(ends) > 1_000_000:
                yield counts()
        if n or ends:
            yield counts()

    # of users only a hash of their last text is looked at
    got = turns(rows.filter("resp_id IS NOT NULL AND conversations IS NOT NULL")).select("a", F.xxhash64(F.lower("q")).alias("q")).mapInPandas(run, "key BIGINT, n BIGINT, asked BIGINT")
    return runtime.materialize(got.groupBy("key").agg(F.sum("n").alias("n"), F.bit_or("asked").alias("asked")), "pairs-vocabulary")


def repeated_clauses(words: DataFrame) -> np.ndarray:
    """Bit map, of bounded size, of the clauses that answers to REPEATED different questions or more share."""
    return bits.bit_map(words.filter(F.bit_count("asked") >= REPEATED), "key")


@dataclass
class Example:
    """Last clauses of an answer with labels; last is the word that they end with, mine whether their own answer gives it to the
    vocabulary, size the characters and clauses of the whole."""

    parts: list[str]
    question: str
    labels: list[int]
    last: str | None
    mine: bool
    size: tuple[int, int]
    again: list[bool] | None = None  # which clauses count as repeated, where not looked up
    found: list[list[int]] | None = None  # its features, once found


def _example(parts: list[str], q: str, label: int, body: str | None = None) -> Example:
    w = asked(parts)
    return Example(parts, q, [label] * len(parts), w, w is not None and body is not None and w in counted(body, parts), (sum(map(len, parts)), len(parts)))


Look = Callable[[list[str]], dict[str, int]]


def _featured(made: list[Example], look: Look, told: Callable[[list[str]], np.ndarray]) -> tuple[list[tuple[list[list[int]], list[int]]], frozenset[str]]:
    """Features and labels of examples, and the words at their ends that are known: a word is known to an example where an
    answer other than its own has it, as for the rows tagged later."""
    n = look([_word_key(x.last) for x in made if x.last is not None])
    again = told([p for x in made if x.found is None and x.again is None for p in x.parts])
    known: set[str] = set()
    out, at = [], 0
    for x in made:
        if here := x.last is not None and n.get(_word_key(x.last), 0) - x.mine >= 1:
            known.add(x.last)
        if x.found is None:
            if x.again is None:
                flags = again[at : at + len(x.parts)].tolist()
                at += len(x.parts)
            else:
                flags = x.again
            x.found = features(x.parts, x.question, allowed_languages(x.question), {x.last} if here else (), flags, x.size)[0]
        out.append((x.found, x.labels))
    return out, frozenset(known)


def aside(q: str, parts: list[str]) -> bool:
    """Whether an answer of prose says nothing with a word of its question: it may decline, or be plain."""
    about = _about(q)
    letters = sum(len(w) for p in parts for w in _WORD.findall(p) if len(w) > 1)
    return len(parts) <= 6 and letters >= 12 and '"' not in "".join(parts) and not any(w in about for p in parts for w in clause_words(p))


def fit(sample: list[tuple[str, str | None, str | None]], look: Look, told: Callable[[list[str]], np.ndarray], usual: float = 3, seed: int = 3, seeds: re.Pattern[str] = SEEDS) -> Field:
    """A field fitted to a sample of (question, answer, finish_reason).

    look gives the numbers of answers with a key (_word_key, _end_key), told which clauses are repeated, of all answers.
    Sound answers are such as end like one and hold no sign of a defect; an ending of usual answers or more is sound. Defects are made
    from them: cut at a random place, replaced by their question in another shape, or by an answer to a question in another language.

    Refusals are learned in two steps. Answers that begin with the wording of seeds start the label. Answers that share no
    word with their question may be refusals in other words and are no examples at first. A first field, which knows a refusal by its
    closing clauses and by its shape as well, labels these; a clause that refusals have and sound answers hardly ever carries the label
    to all open answers that hold it, until nothing changes. The second field is fitted to all.
    """
    rng = random.Random(seed)
    rows = []
    for q, a, fr in sample:
        if a is None:
            continue
        body, open_trace = split_trace(a)
        if canon(body) and not open_trace and (fr or "").strip().lower() != "length":
            rows.append((q, body, clauses(body)))
    ends = look([_end_key(p[-1]) for _, _, p in rows if not _stopped(p[-1], False)])
    made: list[Example] = []

    def add(parts: list[str], q: str, labels: list[int], window: int = 64, own: Container[str] = _All()) -> None:
        w = asked(parts)
        made.append(Example(parts[-window:], q, labels[-window:], w, w is not None and w in own, (sum(map(len, parts)), len(parts))))

    sound: list[tuple[str, str, list[str], str]] = []
    declined: list[tuple[str, str, list[str]]] = []
    open_: list[tuple[str, str, list[str]]] = []

    def add_sound(q: str, b: str, parts: list[str]) -> None:
        cq = canon(q)
        if not (_stopped(parts[-1], False) or ends.get(_end_key(parts[-1]), 0) >= usual):
            return
        ok = allowed_languages(q)
        hits = language_hits(_FENCE.sub(" ", b))
        main = max(hits, key=hits.__getitem__) if hits else ""
        if main and ok and main not in ok:
            return
        labels = []
        for p in parts:
            c = canon(p)
            h = {} if p.startswith("```") else language_hits(p)
            best = max(h, key=h.__getitem__) if h else ""
            labels.append(ECHO if len(c) >= 6 and cq and c in cq else FOREIGN if best and ok and best not in ok else ANSWER)
        own = counted(b, parts)
        add(parts, q, labels, own=own)
        sound.append((q, b, parts, main))
        for _ in range(2):  # whole clauses that lack their full stop
            k = rng.randrange(len(parts))
            bare = re.sub(r"[.!?。？！]+$", "", parts[k])
            if bare and not bare.startswith("```") and not _MARK.fullmatch(parts[k]):
                add([*parts[:k], bare], q, labels[: k + 1], 3, own)
        for _ in range(3):  # answers cut anywhere
            if len(b) > 60:
                cut = b[: rng.randint(len(b) // 5, len(b) - 4)].rstrip()
                got = clauses(cut)
                whole = canon(parts[len(got) - 1]) if len(got) <= len(parts) else ""
                if got and (len(got) > 1 and _MARK.fullmatch(got[-1]) or not _END.search(got[-1]) and canon(got[-1]) != whole):
                    add(got, q, [*labels[: len(got) - 1], *[ANSWER] * max(0, len(got) - 1 - len(labels)), UNFINISHED], 3, own)
        if rng.random() < 0.15 and cq:
            shape = rng.choice([str.upper, str.title, str.lower, lambda s: "> " + s, lambda s: "Question: " + s, lambda s: s + "\n\n" + s])
            got = clauses(shape(q))
            if got:
                add(got, q, [ECHO] * len(got), own=frozenset())
        marks = [k for k in range(1, len(parts)) if _LISTED.match(parts[k])]
        if marks:  # cut behind a list mark
            k = rng.choice(marks)
            add([*parts[:k], _LISTED.match(parts[k]).group(0).strip()], q, [*labels[:k], UNFINISHED], 3, own)

    for q, b, parts in rows:
        if is_copy(q, b):
            add(parts, q, [ECHO] * len(parts), own=counted(b, parts))
        elif aside(q, parts):
            (declined if seeds.search(parts[0]) else open_).append((q, b, parts))
        elif not seeds.search(parts[0]):
            add_sound(q, b, parts)

    def mixed(n: int) -> list[Example]:
        """Refusals put together anew from their first and later clauses, for questions of sound answers."""
        first, later = [p[0] for _, _, p in declined], [x for _, _, p in declined for x in p[1:]]
        out = []
        for _ in range(n if first and sound else 0):
            got = [rng.choice(first), *(rng.choice(later) for _ in range(rng.randrange(3)) if later)]
            out.append(_example(got, rng.choice(sound)[0], REFUSAL))
        return out

    def in_other_words(p: list[str], q: str, label: int, again: list[bool]) -> Example:
        """An answer of the same shape in words that nobody else has, small words aside, so that not the words are learned."""
        p = [_WORD.sub(lambda m: m[0] if m[0].lower() in _WORD_LANG else "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in m[0]), x) if rng.random() < 0.7 else x for x in p]
        return replace(_example(p, q, label), again=again)

    def shapes() -> list[Example]:
        """Without known words, short answers that many questions share have the shape of refusals, and all others that of answers."""
        out = [in_other_words(p, q, ANSWER, told(p).tolist()) for q, _, p, _ in sound if len(p) <= 3 and rng.random() < 0.5]
        out += [in_other_words(p[: rng.randint(1, 2)], q, ANSWER, [False] * 2) for q, _, p, _ in sound if rng.random() < 0.1]
        for q, _, p in declined:
            mine = told(p).tolist()
            if 2 * sum(mine) >= len(p):
                out += [in_other_words(p, q, REFUSAL, mine) for _ in range(3)]
        return out

    def refusals() -> list[Example]:
        return [_example(p, q, REFUSAL, b) for q, b, p in declined] + mixed(3 * len(declined))

    if declined and open_:
        ex, known = _featured([*made, *refusals(), *shapes()], look, told)
        early = fit_field(ex, known, epochs=2)
        ex, _ = _featured([_example(p, q, REFUSAL, b) for q, b, p in open_], look, told)
        votes = [(y == REFUSAL).mean() > 0.5 for y in early.decode([f for f, _ in ex])]
        odds = [early.scores(f) for f, _ in ex]
        unclear = [bool((e[:, REFUSAL] > e[:, ANSWER] - 3).any()) for e in odds]  # a refusal at odds of one to twenty or more
        elsewhere = Counter(k for _, _, parts, _ in sound for k in {clause_key(p) for p in parts})
        while True:
            own = Counter(k for p in [*(p for _, _, p in declined), *(p for (_, _, p), v in zip(open_, votes) if v)] for k in {clause_key(x) for x in p})
            again = [v or any(own[k] > 5 * elsewhere[k] for k in map(clause_key, p)) for (_, _, p), v in zip(open_, votes)]
            if again == votes:
                break
            votes = again
        declined += [x for x, v in zip(open_, votes) if v]
        open_ = [x for x, v, u in zip(open_, votes, unclear) if not v and not u]
    # of the rest, what many questions are answered by may still decline, so it is no example of either kind, nor is what the first field isn't sure of
    vague = told([p for _, _, parts in open_ for p in parts]).tolist()
    for q, b, parts in open_:
        mine, vague = vague[: len(parts)], vague[len(parts) :]
        if not any(mine):
            add_sound(q, b, parts)
    made += refusals() + shapes()
    by = Counter(m for *_, m in sound if m)
    for q, b, parts, main in sound:
        if rng.random() < 0.2 and len(by) > 1 and main:
            other = sound[rng.randrange(len(sound))]
            for _ in range(20):
                if other[3] and other[3] not in allowed_languages(q) and allowed_languages(q):
                    break
                other = sound[rng.randrange(len(sound))]
            else:
                continue
            add(other[2], q, [ANSWER if p.startswith("```") or not language_hits(p) else FOREIGN for p in other[2]], own=counted(other[1], other[2]))
    ex, known = _featured(made, look, told)
    return fit_field(ex, known)


def intro(q: str) -> int:
    """Letters and digits that a copy of a question may be introduced by."""
    return max(INTRO, int(len(q) * INTRO_SHARE))


def is_copy(question: str, answer: str) -> bool:
    """The exact check of a copy: the question's letters and digits, perhaps introduced, repeated, or short of its last
    words, and nothing else. The limits grow with the question."""
    q, a = canon(question), canon(answer)
    if not q or not a:
        return False
    at = a.find(q)
    if 0 <= at <= intro(q):
        rest = a[at:].replace(q, "\x00").strip("\x00").replace("\x00", "")
        return rest == "" or q.startswith(rest)
    words = question.split()
    tail = len(canon(" ".join(words[-max(MISSING_WORDS, int(len(words) * MISSING_SHARE)) :])))
    least = max(len(q) - tail, len(q) // 2, 6)
    for at in range(min(intro(q), len(a)) + 1):
        n = len(a) - at
        if least <= n < len(q) and q.startswith(a[at:]):
            return True
    return False


def judge(question: str, answer: str, labels: np.ndarray, sizes: list[int], told: list[bool]) -> str | None:
    """Defect of a pair from the coverage of its clauses; None for a sound one."""
    tags = labels.tolist()
    if not any(tags):
        return None
    n = [0] * len(LABELS)
    known = 0
    for k, w, t in zip(tags, sizes, told):
        n[k] += w
        known += w if t else 0
    total = sum(n)
    if total and n[ECHO] >= 0.5 * total and is_copy(question, answer):
        return "copied"
    if n[REFUSAL] > 0.5 * total and n[REFUSAL] >= 2 * n[ANSWER]:
        return "refusal"
    if known and n[FOREIGN] > 0.5 * known:
        hits, ok = language_hits(_FENCE.sub(" ", answer)), allowed_languages(question)
        if hits and ok and max(hits, key=hits.__getitem__) not in ok:
            return "other_language"
    return "truncated" if tags[-1] == UNFINISHED else None


def train(rows: DataFrame, sample: int = SAMPLE, words: DataFrame | None = None, seeds: re.Pattern[str] = SEEDS) -> Field:
    """Fits the field on sample rows of (resp_id, conversations, finish_reason), those of lowest hash; words is the vocabulary of all
    rows, counted here unless given. The driver looks up only what the examples end with, and holds the bit map of repeated clauses."""
    words = vocabulary(rows) if words is None else words
    cut = F.transform("conversations", lambda m: F.struct(m["role"].alias("role"), F.substring(m["content"], 1, SAMPLE_CHARS).alias("content")))
    place = F.pmod(F.xxhash64("resp_id"), F.lit(2**40))
    known = rows.filter("resp_id IS NOT NULL AND conversations IS NOT NULL").withColumn("h", place)
    # all rows' places are uniform: those below this bound are a little more than the sample, so little more is sent
    n_rows = known.count()
    bound = int(2**40 * min(1.0, 1.2 * (sample + 50) / max(1, n_rows)))
    got = known.filter(F.col("h") < bound).select("resp_id", "finish_reason", cut.alias("c"), "h").orderBy("h", "resp_id").limit(sample).collect()
    made = []
    for r in got:
        q, a = question_and_answer([m.asDict() if m is not None else None for m in r["c"]])
        made.append((q, a, r["finish_reason"]))
    shared = repeated_clauses(words)

    def look(keys: list[str]) -> dict[str, int]:
        keys = sorted(set(keys))
        if not keys:
            return {}
        h = _hashes(keys).tolist()
        few = rows.sparkSession.createDataFrame(pd.DataFrame({"key": h}), "key BIGINT").distinct()
        n = {r["key"]: r["n"] for r in words.join(F.broadcast(few), "key").collect()}
        return {k: n.get(x, 0) for k, x in zip(keys, h)}

    model = fit(made, look, lambda parts: bits.hits(shared, _clause_hashes(clause_keys(parts))), max(3, 3 * n_rows / sample), seeds=seeds)
    return replace(model, repeated=shared)


def _input_name(rows: DataFrame, sample: int) -> str | None:
    """A name for the files that rows are read from, by path, size and time, for the plan on them and for this module; None if
    they have none."""
    spark = rows.sparkSession
    files = sorted(rows.inputFiles())
    if not files:
        return None
    state = [f"{sample}", hashlib.md5(Path(__file__).read_bytes()).hexdigest(), rows._jdf.queryExecution().analyzed().canonicalized().toString()]
    for x in files:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(x)
        st = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
        state.append(f"{x} {st.getLen()} {st.getModificationTime()}")
    return hashlib.md5("\n".join(state).encode()).hexdigest()


def trained(rows: DataFrame, sample: int = SAMPLE, words: DataFrame | None = None) -> Field:
    """The field of these rows: fitted once and kept in the shared folder under the name of their files."""
    name = _input_name(rows, sample)
    spark = rows.sparkSession
    path = f"{runtime.shared_dir(spark)}/pairs-field-{name}"
    if name and (got := runtime.read_bytes(spark, path)) is not None:
        with np.load(io.BytesIO(got), allow_pickle=False) as z:
            emit = np.zeros((BUCKETS, len(LABELS)))
            emit[z["used"]] = z["emit"]
            return Field(emit, z["move"], frozenset(z["known"].tolist()), z["repeated"])
    model = train(rows, sample, words)
    if name:
        used = np.flatnonzero(np.abs(model.emit).max(1) > 0)
        out = io.BytesIO()
        np.savez_compressed(out, used=used, emit=model.emit[used], move=model.move, known=np.array(sorted(model.known), dtype=str), repeated=model.repeated)
        runtime.write_bytes(spark, path, out.getvalue())
    return model


def defects(rows: DataFrame, field: Field | None = None, sample: int = SAMPLE) -> DataFrame:
    """(resp_id, defect) of each defective row of (resp_id, conversations, finish_reason); sound rows give none.

    Null conversations, missing assistant turns and answers without a letter or digit are empty; finish_reason length
    and a trace never closed are truncated; all else is told by the tags of the field, fitted here unless given. Whole
    answers are tagged. A row whose verdict depends on whether its last word is known is tagged both ways, and the two are told apart by a join
    with the vocabulary of all answers (and of the field's, if given). Repeated rows are judged each on their own; other columns don't matter.
    """
    words = vocabulary(rows)
    trusted: frozenset[str] = field.known if field is not None else frozenset()
    maps = [repeated_clauses(words)]
    if field is None:
        field = trained(rows, sample, words)
    else:
        maps.append(field.repeated)
    used = np.flatnonzero(np.abs(field.emit).max(1) > 0)
    sent = rows.sparkSession.sparkContext.broadcast((used, field.emit[used].astype(np.float32), field.move, trusted, maps))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, w, move, trusted, maps = sent.value
        emit = np.zeros((BUCKETS, len(LABELS)), dtype=np.float32)
        emit[used] = w
        model = Field(emit, move, trusted)
        unknown = emit[_bucket("e_unknown")]

        def if_unknown(e: np.ndarray) -> np.ndarray:
            e = e.copy()
            e[-1] += unknown
            return e

        for pdf in batches:
            out: list[tuple[int, str | None, str | None, str | None, int]] = []  # id, defect, defect if the last word is unknown, that word, is it elsewhere in the row
            split: list[tuple[int, str, str, list[str]]] = []
            for i, q, a, fr in zip(pdf["resp_id"], pdf["q"], pdf["a"], pdf["finish_reason"]):
                body, open_trace = split_trace(a) if a is not None else ("", False)
                if open_trace or fr is not None and str(fr).strip().lower() == "length":
                    out.append((i, "truncated", None, None, 0))
                elif not _SAYS.search(body):
                    out.append((i, "empty", None, None, 0))
                else:
                    split.append((i, q, body, clauses(body)))
            todo: list[tuple[int, str, str, np.ndarray, list[int], list[bool], str | None, list[str]]] = []
            for k in range(0, len(split), 256):  # so few that their words stay in the cache
                some = split[k : k + 256]
                words = [said(parts) for *_, parts in some]
                h = _clause_hashes([k for w in words for k in said_keys(*w)])
                flags = np.zeros(len(h), dtype=bool)
                for m in maps:
                    flags |= bits.hits(m, h)
                at = 0
                got = []
                for (_, q, _, parts), ws in zip(some, words):
                    got.append(features(parts, q, allowed_languages(q), _All(), flags[at : at + len(parts)].tolist(), None, ws))
                    at += len(parts)
                for (i, q, body, parts), (_, sizes, prose), e in zip(some, got, model.row_scores([f for f, _, _ in got])):
                    last = asked(parts)
                    todo.append((i, q, body, e, sizes, prose, None if last in trusted else last, parts))
            both = [t for t in todo if t[6] is not None]
            other = {id(t): judge(t[1], t[2], y, t[4], t[5]) for t, y in zip(both, model.best([if_unknown(t[3]) for t in both]))}
            for t, y in zip(todo, model.best([t[3] for t in todo])):
                d = judge(t[1], t[2], y, t[4], t[5])
                e = other.get(id(t), d)
                if d or e:
                    out.append((t[0], d, e, t[6] if d != e else None, int(d != e and t[6] in counted(t[2], t[7]))))
            sure = [r[3] is None for r in out]
            # keys of sure rows only spread them
            key = _hashes([str(r[0]) if r[3] is None else _word_key(r[3]) for r in out]) if out else np.empty(0, dtype=np.int64)
            cols = {"resp_id": pd.Series([r[0] for r in out], dtype="int64"), "defect": pd.Series([r[1] for r in out], dtype="object"), "other": pd.Series([r[2] for r in out], dtype="object")}
            yield pd.DataFrame({**cols, "key": key, "own": pd.Series([r[4] for r in out], dtype="int32"), "sure": pd.Series(sure, dtype="bool")})

    tags = turns(rows.filter("resp_id IS NOT NULL")).mapInPandas(run, "resp_id BIGINT, defect STRING, other STRING, key BIGINT, own INT, sure BOOLEAN").join(words.select("key", "n"), "key", "left")
    known = F.col("sure") | (F.coalesce("n", F.lit(0)) - F.col("own") >= 1)
    return tags.select("resp_id", F.when(known, F.col("defect")).otherwise(F.col("other")).alias("defect")).filter("defect IS NOT NULL")


def summary(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(defect, n_rows, share of all rows), one row for each kind found."""
    n = rows.agg(F.count(F.lit(1)).alias("n_all"))
    by = found.groupBy("defect").agg(F.count(F.lit(1)).alias("n_rows"))
    return by.crossJoin(F.broadcast(n)).select("defect", "n_rows", (F.col("n_rows") / F.col("n_all")).alias("share"))
