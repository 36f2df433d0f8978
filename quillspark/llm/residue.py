"""Problem 9: template residue, filler, error pages and script notices in place of content, told by aligning records.

No wording and no slot syntax is listed here. Sentences that many records share, the company they keep, the words that
stand at one place of otherwise equal records, and the words that records of a language share decide.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from quillspark import runtime
from quillspark.llm import bits

LEAST_COPIES = 5  # records that must agree before anything is induced from them
COMPANY = 0.6  # mean share of shared sentences in the rest of its documents from which a shared sentence is residue
COVER = 0.5  # share of residue in a document's content from which the document is a case
PAGE_WORDS = 60  # words up to which a text has the shape of an error page or a notice
MENU_WORDS = 6  # words up to which a line without a sentence's end may be a menu
WIDEST = 3  # words that the value of a slot has at most
GAP = 4  # words that records of one page template may differ in within a sentence
FREQUENT = 0.1  # share of a language's documents that hold a word, from which it is a common word
KNOWN_LANGUAGE = 50  # documents with a language's label from which its common words are known
HOT_SHARE = 10_000  # a key with more than one HOT_SHARE-th of all rows is hot: there are fewer than HOT_SHARE

#: HTML elements, which are no slots.
TAGS = frozenset("a b i p u s br hr em li ol ul td th tr div img pre sub sup code html head body span table strong think answer".split())
#: Signs that prose puts around words as well: a name in these only must be known from another marker.
PROSE_SIGNS = frozenset(["[", "«", "<", "]", "»", ">"])

_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.DOTALL)
_MENTION = re.compile(r"`[^`\n]*`|\bf?\"[^\"\n]*\"|[“„][^”“\n]*[”“]|\$[^$\n]*[\\^=_][^$\n]*\$|\\[a-zA-Z]+(?:\{[^\n]*?\}+)+")
_CUT = re.compile(r"\n+|(?<=[.!?])\s+|(?<=[。？！])")
_ENDED = re.compile(r"[.!?。？！:]\W*$")
_PROSE = re.compile(r"[^\W\d_][^\W\d_\s.,!?'’;:-]*(?:[\s.,!?'’;:-]+[^\W\d_]+)*[\s.,!?'’;:-]*")
_DIGITS, _GAPS = re.compile(r"\d+"), re.compile(r"\W+")
_PLAIN = re.compile(r"[a-z0-9_]+")
_UNIT = re.compile(r"[぀-ヿ㐀-鿿]|[^\W぀-ヿ㐀-鿿]+")
_CAPITAL = re.compile(r"(?<=\w\s)(?=[A-ZÀ-ÞА-ЯЁ])")
#: Signs outside of prose, its punctuation and light markup.
_SIGN = r"[^\w\s.,;:!?'’\"“”„()*`|/\\&+=~^°€£§…–—•　-〿＀-･-]"
_HAS_SIGN = re.compile(_SIGN + r"|__| [.,;:!?]|  ")
#: Words between signs that aren't glued to a word before them; a letter glued behind belongs to the sign.
_MARKED = re.compile(rf"(?<![\w)\]])((?:{_SIGN}){{1,3}}[(=]{{0,2}}) ?([^\W\d_](?:[\w .|-]{{0,38}}\w)?) ?([)=]?(?:{_SIGN}){{1,3}}|\)[a-z]\b)|(?<![A-Za-z0-9])(__+)([^\W_]\w*?)(__+)(?!\w)")
#: A word that is a name in a program: with an underscore inside.
_NAME = re.compile(r"(?<!\w)[^\W\d_]+(?:_[^\W_]+)+(?!\w)")
#: Nothing where a word should be: two gaps in a row, a gap before a point or comma, or a ruled line.
_BLANK = re.compile(r"(?<=\w)[^\S\n]+(?=[.,;!?])|(?<=[\w,;]) {2,}(?=\w)|(?<=\w)\s*_{3,}\s*(?=[\w.,;!?])")
MARKED, NAMED, BLANK = 1, 2, 3


def _hash(texts: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(texts, dtype=object), categorize=False).view(np.int64) if texts else np.empty(0, dtype=np.int64)


def _bare(s: str) -> str:
    """A sentence without code, formulas and quotations."""
    return _MENTION.sub(" ", s) if any(q in s for q in "`\"“„$\\") else s


def sentences(text: str | None) -> tuple[list[str], int]:
    """(lines and sentences that hold a word, length of fenced code) of a text."""
    if not text or not text.strip():
        return [], 0
    code = 0
    if "```" in text or "~~~" in text:
        code = sum(len(m.group(0)) for m in _FENCE.finditer(text))
        text = _FENCE.sub("\n", text)
    return [s for s in (x.strip() for x in _CUT.split(text.strip())) if _UNIT.search(s)], code


def skeleton(s: str) -> str:
    """What records of one template share of a sentence: its words in lower case, numbers as one."""
    t = _DIGITS.sub("0", s.lower())
    return " ".join(_PLAIN.findall(t)) if t.isascii() else _GAPS.sub(" ", t).strip()


def units(s: str) -> list[str]:
    """Words in lower case, numbers as one, each ideograph on its own."""
    t = _DIGITS.sub("0", s.lower())
    return (_PLAIN if t.isascii() else _UNIT).findall(t)


# frames: what stands around a place. 1: the word on either side. 3: up to three words on either side.
_EDGE = np.uint64(0x9E3779B97F4A7C15)
_A, _B, _C, _D, _E = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    return h ^ (h >> np.uint64(29))


def _contexts(h: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of up to three words up to each place, of up to three words from it on, and how many words these are
    before and behind (tens and units); both stop at an edge."""

    def run(h: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, n, live = h * _B, (~edge).astype(np.int64), ~edge
        for k, m in ((1, _C), (2, _D)):
            prev = np.concatenate([np.full(k, _EDGE, dtype=np.uint64), h[:-k]])[: len(h)]
            on = np.concatenate([np.ones(k, dtype=bool), edge[:-k]])[: len(h)]
            out = out + np.where(live, prev * m, np.uint64(0))
            live = live & ~on
            n = n + live
        return _mix(out), n

    left, a = run(h, edge)
    right, b = run(h[::-1], edge[::-1])
    return left, right[::-1], a * 10 + b[::-1]


def _frames(h: np.ndarray, edge: np.ndarray, i: np.ndarray, j: np.ndarray, wide: bool) -> np.ndarray:
    """Hash of the frame between places i and j; 0 where it holds too little to align by."""
    with np.errstate(over="ignore"):
        if wide:
            left, right, n = _contexts(h, edge)
            got = _mix(left[i] * _D + right[j] * _E)
            return np.where(n[i] // 10 + n[j] % 10 >= 3, got, np.uint64(0))
        got = _mix(h[i] * _B + h[j] * _E + _C)
        return np.where(edge[i] & edge[j], np.uint64(0), got)


def candidates(segs: list[str]) -> list[tuple[int, int, int, int, int, bool, list[int]]]:
    """(segment, kind, frame, name, sign, in prose signs only, parts of the name) of each place that may be an open slot:
    a marked name, a program's name as it stands, or a blank. Quotations, code and formulas have none, and a name that the text
    also quotes is what it speaks of."""
    out = []
    quoted = " ".join(m.group(0) for s in segs if any(q in s for q in "`\"“„$\\") for m in _MENTION.finditer(s)).lower()
    for k, s in enumerate(segs):
        if not (_HAS_SIGN.search(s) or "_" in s):
            continue
        b = _DIGITS.sub("0", _bare(s).lower())
        at = [(MARKED, m.start(), m.end(), m.group(2) or m.group(5), (m.group(1) or m.group(4)) + (m.group(3) or m.group(6))) for m in _MARKED.finditer(b)]
        at = [x for x in at if b[x[1] : x[2]].strip("<>/ ") not in TAGS]
        at += [(NAMED, m.start(), m.end(), m.group(0), "") for m in _NAME.finditer(b) if m.group(0) not in quoted and not any(x[1] <= m.start() < x[2] for x in at)]
        at += [(BLANK, m.start(), m.end(), "", "") for m in _BLANK.finditer(b)]
        if not at:
            continue
        w = list(_UNIT.finditer(b))
        if not w:
            continue
        starts, ends = [m.start() for m in w], [m.end() for m in w]
        h = np.concatenate([[_EDGE], _hash([m.group(0) for m in w]).view(np.uint64), [_EDGE]])
        edge = np.zeros(len(h), dtype=bool)
        edge[[0, -1]] = True
        for kind, x, y, name, sign in at:
            i = int(np.searchsorted(ends, x, side="right"))  # words that end before the place; the left one is at i behind the edge
            j = int(np.searchsorted(starts, y, side="left")) + 1
            f = int(_frames(h, edge, np.array([i]), np.array([j]), kind != MARKED).view(np.int64)[0])
            if f:
                parts = units(name.replace("_", " "))
                subs = [" ".join(parts[p:q]) for p in range(len(parts)) for q in range(p + 1, min(len(parts), p + WIDEST) + 1)]
                out.append((k, kind, f, int(_hash([" ".join(parts)])[0]) if name else 0, int(_hash([sign])[0]), bool(sign) and all(c in PROSE_SIGNS for c in sign), _hash(subs).tolist()))
    return out


def variants(k: int, s: str) -> list[tuple[int, str, int, bool]]:
    """(segment, skeleton, length, whether it is a part) of what a short page's sentence may share with others: itself but
    for one to GAP words, and its parts before and behind a capital letter."""
    w = skeleton(s).split(" ")
    out = [(k, " ".join([*w[:i], "∅", *w[i + n :]]), len(s), False) for n in range(1, min(GAP, len(w) - 2) + 1) for i in range(len(w) - n + 1)]
    for m in _CAPITAL.finditer(s):
        for part in (s[m.start() :], s[: m.start()].strip()):
            if part.count(" ") >= 1:
                out.append((k, skeleton(part), len(part), True))
    return out


_DOC = pa.schema([
    ("doc_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.list_(pa.int32())), ("lines", pa.list_(pa.bool_())), ("title", pa.bool_()), ("code", pa.int32()),
    ("page", pa.int64()), ("body", pa.int64()), ("alts", pa.list_(pa.struct([("seg", pa.int32()), ("key", pa.int64()), ("size", pa.int32()), ("part", pa.bool_())]))),
    ("places", pa.list_(pa.struct([("seg", pa.int32()), ("kind", pa.int32()), ("frame", pa.int64()), ("name", pa.int64()), ("sign", pa.int64()), ("prose", pa.bool_()), ("subs", pa.list_(pa.int64()))]))),
    ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()),
])
_LOOK = pa.schema([("doc_id", pa.int64()), ("odd", pa.list_(pa.int32())), ("frame", pa.int64()), ("value", pa.int64()), ("open", pa.bool_()), ("n", pa.int64())])


def _batch(schema: pa.Schema, cols: dict[str, object], n: int) -> pa.RecordBatch:
    """A batch of n rows from some columns; the others are null."""
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, and behind them rows (lang, word, n) with the numbers of documents that hold each word."""
    seen: defaultdict[str, Counter[str]] = defaultdict(Counter)

    def words() -> pa.RecordBatch:
        rows = [(k, w, n) for k, by in seen.items() for w, n in by.items()]
        seen.clear()
        return _batch(_DOC, dict(zip(("lang", "word", "n"), zip(*rows))), len(rows))

    names = _DOC.names[:11]
    for batch in batches:
        out = []
        for d, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
            segs, code = sentences(text)
            keys = [skeleton(s) for s in segs]
            each = [k.split(" ") if k.isascii() else units(k) for k in keys]
            n = [len(w) for w in each]
            if segs:
                seen[(lang or "").strip().lower()[:2]].update({"", *chain.from_iterable(each)})
            lines = [not _ENDED.search(s) for s in segs]
            alts = [x for i, s in enumerate(segs) for x in variants(i, s)] if not code and sum(n) <= PAGE_WORDS else []
            h = _hash([*keys, *(x[1] for x in alts), "\n".join(keys), (text or "").strip()]).tolist()
            alts = [{"seg": x[0], "key": y, "size": x[2], "part": x[3]} for x, y in zip(alts, h[len(keys) :])]
            at = [dict(zip(("seg", "kind", "frame", "name", "sign", "prose", "subs"), x)) for x in candidates(segs)]
            page = h[-2] if segs and not code and sum(n) <= PAGE_WORDS else None
            out.append((d, h[: len(keys)], [len(s) for s in segs], n, lines, bool(lines and lines[0] and len(segs) > 1), code, page, h[-1], alts, at))
        yield _batch(_DOC, dict(zip(names, zip(*out))) if out else {}, len(out))
        if sum(map(len, seen.values())) > 500_000:
            yield words()
    if seen:
        yield words()


def _looker(common: frozenset[str], languages: frozenset[str], one: np.ndarray, wide: np.ndarray):  # noqa: ANN202
    """A second pass: (doc_id, odd) sentences of words of which none is common, and (frame, value, n, open) what stands in
    the frames that the maps hold; open values are names as programs have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd, flat = [], [""]
            for d, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                segs, _ = sentences(text)
                known = (lang or "").strip().lower()[:2] in languages
                mine = []
                for k, s in enumerate(segs):
                    w = units(_bare(s))
                    flat += w
                    flat.append("")
                    if known and len(w) >= 4 and common.isdisjoint(w) and _PROSE.fullmatch(s):
                        mine.append(k)
                if mine:
                    odd.append((d, mine))
            codes, uniq = pd.factorize(np.array(flat, dtype=object))
            h = np.where(uniq == "", _EDGE, _hash(uniq.tolist()).view(np.uint64))[codes] if len(uniq) else np.empty(0, dtype=np.uint64)
            edge, name = (uniq == "")[codes], np.array(["_" in w for w in uniq], dtype=bool)[codes]
            got = []
            with np.errstate(over="ignore"):
                left, right, n = _contexts(h, edge)
                for v in range(1, WIDEST + 1):
                    i = np.arange(max(0, len(h) - v - 1))
                    ok = ~edge[i + 1]
                    value = h[i + 1] * _B
                    for k in range(2, v + 1):
                        ok &= ~edge[i + k]
                        value = _mix(value) + h[i + k] * _C
                    i = i[ok]
                    value, j = _mix(value[ok]), i + v + 1
                    open_ = name[i + 1].copy()
                    for k in range(2, v + 1):
                        open_ |= name[i + k]
                    f1 = np.where(edge[i] & edge[j], np.uint64(0), _mix(h[i] * _B + h[j] * _E + _C))
                    f3 = np.where(n[i] // 10 + n[j] % 10 >= 3, _mix(left[i] * _D + right[j] * _E), np.uint64(0))
                    for f, m in ((f1, one), (f3, wide)):
                        on = (f != 0) & bits.hits(m, f)
                        got.append(pd.DataFrame({"frame": f[on].view(np.int64), "value": value[on].view(np.int64), "open": open_[on]}))
            yield _batch(_LOOK, {"doc_id": [x[0] for x in odd], "odd": [x[1] for x in odd]}, len(odd))
            by = pd.concat(got).groupby(["frame", "value", "open"], as_index=False).size()
            yield _batch(_LOOK, {"frame": by["frame"], "value": by["value"], "open": by["open"], "n": by["size"]}, len(by))

    return run


def _looked_up(rows: DataFrame, table: DataFrame, key: str, n_rows: int, how: str) -> DataFrame:
    """rows joined with table (key, n, ...), n being the rows with each key: hot keys, fewer than HOT_SHARE, by broadcast and
    all others by shuffle. table must have every hot key."""
    bar = max(LEAST_COPIES, n_rows // HOT_SHARE)
    hot, cold = table.filter(F.col("n") > bar).drop("n"), table.filter(F.col("n") <= bar).drop("n")
    got = rows.join(F.broadcast(hot), key, "inner")
    return got.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how), allowMissingColumns=True)


def _common_words(rows: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """(words that a FREQUENT share of a language's documents hold, languages with KNOWN_LANGUAGE documents). A language has at
    most the words of 1 / FREQUENT mean documents."""
    by = rows.filter("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    sizes = by.filter(F.col("word") == "").select("lang", F.col("n").alias("all")).filter(F.col("all") >= KNOWN_LANGUAGE)
    got = by.filter("word <> ''").join(F.broadcast(sizes), "lang").filter(F.col("n") >= FREQUENT * F.col("all")).select("word").distinct().collect()
    return frozenset(r[0] for r in got), frozenset(r[0] for r in sizes.select("lang").collect())


def _open_slots(places: DataFrame, values: DataFrame, n_places: int) -> DataFrame:
    """(doc_id, open_slots) of documents with slots left open, open_slots counting their sentences.

    A place is a slot where LEAST_COPIES records or more agree around it and differ in it. A marked name in a slot is open if
    the same name is left in other slots as well, that is in LEAST_COPIES frames or more, or recurs among others in this one;
    a name known in prose signs only is none. A program's name or a blank is open where records fill the slot in with
    LEAST_COPIES words or more of three kinds.
    """
    frames = values.groupBy("frame").agg(
        F.sum("n").alias("all"), F.count(F.lit(1)).alias("kinds"), F.sum(F.when(~F.col("open"), F.col("n")).otherwise(0)).alias("filled"), F.count_if(~F.col("open")).alias("fills")
    )
    own = places.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == MARKED).alias("marked"))
    names = places.filter(F.col("kind") == MARKED).groupBy("frame", "name").agg(F.count(F.lit(1)).alias("c")).groupBy("frame").agg(F.count(F.lit(1)).alias("names"))
    slots = own.join(names, "frame", "left").join(frames, "frame", "left").fillna(0)
    slots = slots.withColumns({
        "slot": (F.col("all") >= LEAST_COPIES) & (F.col("kinds") >= 2),
        "recurs": (F.col("marked") >= LEAST_COPIES) & (F.col("names") >= 2) & (2 * F.col("names") <= F.col("marked")),
        "filled_in": (F.col("filled") >= LEAST_COPIES) & (F.col("fills") >= 3),
    }).select("frame", "n", "slot", "recurs", "filled_in")
    known = places.filter(F.col("kind") == MARKED).groupBy("name").agg(F.count_distinct("frame").alias("frames"), F.count_distinct("sign").alias("signs"), F.bool_and("prose").alias("prose"), F.count(F.lit(1)).alias("n"))
    sound = (F.col("frames") >= LEAST_COPIES) & ((F.col("signs") >= 2) | ~F.col("prose"))
    bar = max(LEAST_COPIES, n_places // HOT_SHARE)
    known = known.filter(sound | (F.col("n") > bar)).select("name", "n", sound.alias("sound"))
    at = _looked_up(places, runtime.materialize(slots, "residue-slots"), "frame", n_places, "inner")
    certain = at.filter((F.col("kind") == MARKED) & F.col("recurs") | (F.col("kind") != MARKED) & F.col("filled_in")).select("doc_id", "seg")
    parts = at.filter((F.col("kind") == MARKED) & F.col("slot") & ~F.col("recurs")).select("doc_id", "seg", F.explode("subs").alias("name"))
    told = _looked_up(parts, runtime.materialize(known, "residue-names"), "name", n_places, "inner").filter("sound").select("doc_id", "seg")
    return certain.unionByName(told).groupBy("doc_id").agg(F.count_distinct("seg").alias("open_slots"))


def _sum(a: str, f) -> Column:  # noqa: ANN001
    return F.aggregate(a, F.lit(0), lambda s, x: s + f(x))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, open_slots, cover, is_residue) of every document with an id; null and empty texts are no residue.

    Records are aligned by their sentences (words in lower case, numbers as one). A sentence that LEAST_COPIES different
    records share is residue if the rest of its documents is made of shared sentences as well, COMPANY on average: real text
    rarely is. A short shared line in other company is a menu. Sentences of words of which none is common in any known
    language are residue too. A document is a case if residue covers COVER of its content; menus and a first line that no other
    record has don't count as content. Short pages are then compared with one gap of up to GAP words, and by the parts of a line,
    with the sentences found so far; a short page that LEAST_COPIES documents repeat whole is a case unless its sentences
    also stand in real text. Independently, slots are induced from the words around them, and a document with a slot that keeps
    a variable's name or nothing is a case (_open_slots).

    Copies count on their own, but agree with one another as one record. Rows that share a doc_id are judged together. All
    counts run over all documents. Fewer than LEAST_COPIES records of a template are not found.
    """
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    src = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", lang.alias("lang"))
    rows = runtime.materialize(src.mapInArrow(_segment, from_arrow_schema(_DOC)), "residue-segments")
    pages = rows.filter("word IS NULL")
    places = runtime.materialize(pages.select("doc_id", F.explode("places").alias("p")).select("doc_id", "p.*"), "residue-places")
    common, languages = _common_words(rows)
    one = bits.bit_map(places.filter(F.col("kind") == MARKED), "frame")
    wide = bits.bit_map(places.filter(F.col("kind") != MARKED), "frame")
    looker = _looker(common, languages, one, wide)
    look = runtime.materialize(src.mapInArrow(looker, from_arrow_schema(_LOOK)), "residue-values")
    values = look.filter("frame IS NOT NULL").groupBy("frame", "value", "open").agg(F.sum("n").alias("n"))
    slots = _open_slots(places, values, places.count())

    # sentences that different records share
    each = pages.select("doc_id", "body", "title", "code", F.posexplode(F.arrays_zip("keys", "sizes", "words", "lines")).alias("seg", "s"))
    each = each.select("doc_id", "body", "title", "code", "seg", F.col("s.keys").alias("key"), F.col("s.sizes").alias("size"), F.col("s.words").alias("words"), F.col("s.lines").alias("line"))
    n_segs = pages.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    bar = max(LEAST_COPIES, n_segs // HOT_SHARE)
    by = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("body").alias("records"))
    shared = runtime.materialize(by.filter((F.col("records") >= LEAST_COPIES) | (F.col("n") > bar)).select("key", "n", (F.col("records") >= LEAST_COPIES).alias("shared")), "residue-shared")
    seg = F.struct("seg", "key", "size", "words", "line", F.coalesce("shared", F.lit(False)).alias("shared"))
    whole = _looked_up(each, shared, "key", n_segs, "left").groupBy("doc_id").agg(F.min("body").alias("body"), F.sum(F.when(F.col("seg") == 0, F.col("code"))).alias("code"), F.bool_or("title").alias("title"), F.collect_list(seg).alias("segs"))
    no_title = F.transform("segs", lambda x: F.when((x["seg"] == 0) & F.col("title") & ~x["shared"], x.withField("size", F.lit(0))).otherwise(x))
    whole = whole.select("doc_id", "body", no_title.alias("segs"), F.coalesce("code", F.lit(0)).alias("code"))
    whole = whole.withColumns({"total": F.col("code") + _sum("segs", lambda x: x["size"]), "known": _sum("segs", lambda x: F.when(x["shared"], x["size"]).otherwise(0))})
    whole = runtime.materialize(whole, "residue-documents")

    # the company that shared sentences keep; copies are one record
    seg_rows = whole.select("doc_id", "body", "total", "known", F.explode(F.filter("segs", lambda x: x["shared"])).alias("s")).select("doc_id", "body", "total", "known", "s.*")
    one_key = seg_rows.groupBy("body", "key").agg(F.min("doc_id").alias("doc_id"), F.max("total").alias("total"), F.max("known").alias("known"), F.max("size").alias("size"), F.max("words").alias("words"), F.bool_and("line").alias("line"))
    company = F.avg(F.when(F.col("total") > F.col("size"), (F.col("known") - F.col("size")) / (F.col("total") - F.col("size"))))
    told = one_key.groupBy("key").agg(company.alias("company"), F.max("words").alias("words"), F.bool_and("line").alias("line")).join(shared.select("key", "n"), "key")
    good = F.coalesce(F.col("company"), F.lit(1.0)) >= COMPANY
    told = told.select("key", "n", good.alias("good"), (~good & F.col("line") & (F.col("words") <= MENU_WORDS)).alias("menu"))
    told = runtime.materialize(told.filter(F.col("good") | F.col("menu") | (F.col("n") > bar)), "residue-told")
    marks = _looked_up(seg_rows, told, "key", n_segs, "inner").groupBy("doc_id").agg(
        F.sum(F.when(F.col("good"), F.col("size")).otherwise(0)).alias("good"), F.sum(F.when(F.col("menu"), F.col("size")).otherwise(0)).alias("menu"),
        F.collect_set(F.when(F.col("good"), F.col("seg"))).alias("done"), F.collect_set(F.when(F.col("menu"), F.col("seg"))).alias("menus"),
    )
    odd = look.filter("odd IS NOT NULL").groupBy("doc_id").agg(F.flatten(F.collect_list("odd")).alias("odd"))
    judged = whole.select("doc_id", "body", "segs", "total").join(marks, "doc_id", "left").join(odd, "doc_id", "left")
    is_odd = F.filter("segs", lambda x: F.array_contains("odd", x["seg"]) & ~F.coalesce(F.array_contains("done", x["seg"]), F.lit(False)))
    judged = judged.withColumn("bad", F.coalesce("good", F.lit(0)) + F.coalesce(_sum(is_odd, lambda x: x["size"]), F.lit(0)))
    judged = judged.withColumn("content", F.col("total") - F.coalesce("menu", F.lit(0)))
    judged = runtime.materialize(judged.select("doc_id", "body", "bad", "content", *(F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("done", "menus")), F.transform("segs", lambda x: F.struct(x["seg"].alias("seg"), x["size"].alias("size"))).alias("sizes")), "residue-judged")

    # short pages: one gap in a sentence, and parts of a line
    alts = pages.filter(F.size("alts") > 0).select("doc_id", F.explode("alts").alias("a")).select("doc_id", "a.*")
    alts = alts.join(judged.select("doc_id", "body", "bad", "content", "done", "menus", "sizes"), "doc_id").filter(~F.array_contains("menus", F.col("seg")))
    counted = F.array_max(F.transform(F.filter("sizes", lambda x: x["seg"] == F.col("seg")), lambda x: x["size"]))  # 0 for a first line that isn't content
    alts = alts.select("doc_id", "body", "bad", "content", "seg", "key", "size", "part", F.coalesce(counted, F.lit(0)).alias("counted"), F.array_contains("done", F.col("seg")).alias("done"))
    alts = runtime.materialize(alts, "residue-variants")
    rest = F.col("content") - F.col("counted")
    beside = F.when(rest > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("bad") - F.when(F.col("done"), F.col("counted")).otherwise(0)) / rest)))
    gaps = alts.filter("NOT part").groupBy("key", "body").agg(F.max(beside).alias("c"), F.count(F.lit(1)).alias("m"))
    gaps = gaps.groupBy("key").agg(F.count("c").alias("records"), F.avg("c").alias("company"), F.sum("m").alias("n"))
    n_alts = alts.count()
    alt_bar = max(LEAST_COPIES, n_alts // HOT_SHARE)
    fits = (F.col("records") >= LEAST_COPIES) & (F.col("company") >= COMPANY)
    gaps = runtime.materialize(gaps.filter(fits | (F.col("n") > alt_bar)).select("key", "n", F.coalesce(fits, F.lit(False)).alias("fits")), "residue-gaps")
    open_alts = alts.filter((F.col("bad") < COVER * F.col("content")) & ~F.col("done") & (F.col("counted") > 0)).select("doc_id", "seg", "key", "size", "part")
    parts = open_alts.filter("part").groupBy("key").agg(F.count(F.lit(1)).alias("n")).join(told.filter("good").select("key", F.lit(True).alias("fits")), "key", "left")
    parts = runtime.materialize(parts.filter(F.col("fits") | (F.col("n") > alt_bar)), "residue-parts")
    close = _looked_up(open_alts.filter("NOT part"), gaps, "key", n_alts, "inner").unionByName(_looked_up(open_alts.filter("part"), parts, "key", n_alts, "inner"))
    more = close.filter("fits").groupBy("doc_id", "seg").agg(F.max("size").alias("size")).groupBy("doc_id").agg(F.sum("size").alias("more"))

    # whole pages; those with a sentence that also stands in real text are none
    real = _looked_up(seg_rows.select("doc_id", "key"), told, "key", n_segs, "left").filter("good IS NULL OR NOT good AND NOT menu").select("doc_id").distinct()
    again = pages.filter("page IS NOT NULL").groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    n_docs = pages.count()
    again = runtime.materialize(again.filter(F.col("n") >= LEAST_COPIES), "residue-pages")
    copies = _looked_up(pages.filter("page IS NOT NULL").select("doc_id", "page"), again, "page", n_docs, "inner").select("doc_id").join(real, "doc_id", "left_anti").distinct().withColumn("repeated", F.lit(True))

    got = pages.select("doc_id").distinct().join(judged.select("doc_id", "bad", "content"), "doc_id", "left").join(more, "doc_id", "left").join(slots, "doc_id", "left").join(copies, "doc_id", "left")
    cover = F.least(F.lit(1.0), F.coalesce((F.col("bad") + F.coalesce("more", F.lit(0))) / F.nullif("content", F.lit(0)), F.lit(0.0)))
    got = got.withColumns({"open_slots": F.coalesce("open_slots", F.lit(0)), "cover": F.when(F.col("repeated"), 1.0).otherwise(cover)})
    return got.select("doc_id", "open_slots", "cover", ((F.col("open_slots") > 0) | (F.col("cover") >= COVER)).alias("is_residue"))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id) of the documents to leave out."""
    return detect(docs).filter("is_residue").select("doc_id")


def clean(docs: DataFrame) -> DataFrame:
    """The documents without those found; all columns stay. Rows with a null doc_id stay."""
    return docs.join(found(docs).distinct(), "doc_id", "left_anti")
