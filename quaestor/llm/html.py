"""HTML extraction by a suffix array of each host.

Every page becomes a stream of blocks, each in one of these zones: the page's body (inside
`article` or `main`, and a headline outside of all surroundings), what the markup names as
surroundings (menus, footers, adverts, forms, comments ...), and the unmarked rest. A page's main
text is its body, or without one its unmarked text. Bodies, unmarked text and surroundings of every
page are the host's token stream; pages whose main text is equal (or, without any, whose
surroundings are) are one content.

Suffixes are ordered by prefix doubling: they are sorted and ranked by their first token, then round
by round by two ranks, their own and that of the suffix where theirs ends, up to RUN and then LONG
tokens (`prefixes`). Suffixes of equal rank share that long a substring, and the distinct contents
among them are counted; one on fewer contents than any rule asks for needs no further order.
Substrings of RUN tokens on a SHARE of the host's contents and at least LEAST, or of LONG tokens on
LONG_PAGES of them, are boilerplate.

Decision: surroundings go, and unmarked text beside a body goes. Of the main text covered tokens go
and the unique runs between stay; a page that would lose more than MOST of its main text keeps all
of it, since then its main text is what repeats.

Of a marked page, tokens enter the order that are in a run of RUN tokens on as many contents as any rule
asks for on that host, and in a main text. No others can be in boilerplate. They are found by counting
hashes of all runs (`repeated`), where a collision only lets more in; the order then compares the
tokens themselves.

No task holds a host: suffixes of a rank are summed in each task first, ranks come from a range
sort (`dense_positions`) in every round, and only one page's positions meet in a row. `extract_group` is the same
for the pages of one host in memory.

Defined cases: null or empty html gives an empty text; pages without url share the empty host;
unclosed and stray tags, comments and scripts are tolerated; text after a `<` that no tag ends is
text; scanning takes time linear in the page; rows that repeat are extracted one by one; an empty
table gives an empty result. Other columns of the table play no part.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.llm.arrays import Words, buffer, lists, map_slices, mix, shingles, slices, tuned
from quaestor.llm.graph import stored
from quaestor.llm.similar import BROADCAST_BYTES, bounded
from quaestor.operators.ordering import dense_positions

RUN = 6  # tokens
SHARE = 0.5  # of the host's contents
LEAST = 3
LONG = 24  # tokens
LONG_PAGES = 10
NEED_BITS = (LONG_PAGES - LEAST).bit_length()
IN_MAIN = 128  # beside a count
RANK_BITS = 37
ONE = np.uint64(1)
MOST = 0.9
TOGETHER = 2_000_000  # hashes of runs that a task sorts, or sums, at a time
BODY, NAMED, REST, SOFT, HEAD = range(5)

# fixed values: element names and class words of public pages
RAW = "script style noscript template textarea title iframe object svg math canvas audio video select"
NAMED_TAGS = set("nav footer aside form menu dialog button label input header".split())
BODY_TAGS = {"article", "main"}
RAW_TO_END = set("style script noscript textarea title iframe".split())  # unclosed: up to the page's end
FOREIGN = {"svg", "math"}
CONTAINERS = set("div ul ol dl table".split())
NEGATIONS = set("has no with without".split())
COMMENT_WORDS = set("comment comments reply replies".split())
LISTING_WORDS = set("related recommended promotion widget widgets".split())
STRONG_WORDS = COMMENT_WORDS | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo commentlist respond disqus newsletter cookie cookies".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
CLOSES_ITSELF = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
NAMED_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe signup comment comments commentlist reply replies "
    "respond disqus sidebar aside widget widgets related recommended share sharing social menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead toolbar pagination pager login search contentinfo complementary".split()
)

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\s/>])", re.I | re.A) for name in RAW.split()}


def _marks(name: str, attributes: str, zone: int) -> int | None:
    """What an element's attributes make of it: NAMED, SOFT (surroundings, unless an article is
    inside) or None. `has-sidebar` and the like say nothing. Of articles, and of paragraphs and
    sections inside a body, only words count that are never a topic's name."""
    found = None
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or key == "style" and _NONE.search(value) or key == "aria-hidden" and value.lower() == "true":
            return NAMED
        if key not in ("class", "id", "role"):
            continue
        for part in value.split():
            words = [w.lower() for w in _WORD.findall(part)]
            if not words or words[0] in NEGATIONS:
                continue
            if name in BODY_TAGS:
                if words[0] in COMMENT_WORDS:
                    return NAMED
            elif not STRONG_WORDS.isdisjoint(words):
                return NAMED
            elif (zone != BODY or name in CONTAINERS) and not NAMED_WORDS.isdisjoint(words):
                if not LISTING_WORDS.isdisjoint(words):
                    return NAMED
                found = SOFT
    return found


class _Scanner:
    """Splits a page into text, opening and closing tags, in time linear in its length: whatever
    is not found once is not looked for again."""

    def __init__(self, page: str):
        self.page = page
        self.quoted = True  # quotes hide a '>' until that leaves a tag without an end
        self.unclosed: set[str] = set()  # raw elements and quotes without another end

    def _tag_end(self, at: int) -> int:
        page, k = self.page, at
        while self.quoted:
            m = _QUOTE.search(page, k)
            if m is None:
                self.quoted = False
            elif m[0] == ">":
                return m.start()
            else:
                end = -1 if m[0] in self.unclosed else page.find(m[0], m.end())
                if end < 0:
                    self.unclosed.add(m[0])
                k = max(end + 1, m.end())
        return page.find(">", at)

    def __iter__(self):
        """(text, None, None), ("", name, attributes) or ("/", name, "")."""
        page, at = self.page, 0
        while at < len(page):
            lt = page.find("<", at)
            if lt != at:
                yield page[at : lt if lt >= 0 else len(page)], None, None
            if lt < 0:
                return
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(page)
                continue
            slash = page.startswith("/", lt + 1)
            m = _NAME.match(page, lt + 1 + slash)
            if m is None and page[lt + 1 : lt + 2] not in ("!", "?"):
                yield "<", None, None
                at = lt + 1
                continue
            end = self._tag_end(m.end()) if m else page.find(">", lt)
            if end < 0:  # no tag from here on
                comment = page.find("<!--", lt)
                yield page[lt : comment if comment >= 0 else len(page)], None, None
                return
            at = end + 1
            if m is None:
                continue
            name = m[0].lower()
            if slash:
                yield "/", name, ""
            elif name in _CLOSE:
                if name in FOREIGN and page[end - 1] == "/":
                    continue
                close = None if name in self.unclosed else _CLOSE[name].search(page, at)
                if close:
                    end = page.find(">", close.end())
                    at = end + 1 if end >= 0 else len(page)
                else:
                    self.unclosed.add(name)
                    if name in RAW_TO_END:
                        return
            else:
                yield "", name, page[m.end() : end]


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order; white space is one space, references decoded."""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = [("", REST)]
    opened: Counter = Counter()  # of the stack
    piece: list[str] = []

    def flush():
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            if text:
                zone = stack[-1][1]
                out.append((NAMED if zone == SOFT else HEAD if zone == REST and stack[-1][0] == "h1" else zone, text))
            piece.clear()

    def cut(k: int):
        opened.subtract(n for n, _ in stack[k:])
        del stack[k:]

    for text, name, attributes in _Scanner(page or ""):
        if name is None:
            piece.append(text)
            continue
        if text:
            if name in BLOCK:
                flush()
            for k in range(len(stack) - 1, 0, -1) if opened[name] > 0 else ():
                if stack[k][0] == name:
                    flush()
                    cut(k)
                    break
                if name not in BLOCK and stack[k][0] in BLOCK:
                    break
            continue
        inner = zone = stack[-1][1]
        if zone != NAMED and (zone != SOFT or name in BODY_TAGS):
            marks = _marks(name, attributes, zone) if attributes and name not in ("html", "body") else None
            if name in BODY_TAGS:
                inner = BODY if marks is None else NAMED
            elif name in NAMED_TAGS and not (name == "header" and zone == BODY) or name == "head":
                inner = NAMED
            elif marks is not None:
                inner = marks
        if name in BLOCK:
            flush()
            limits = CLOSES_ITSELF.get(name, "").split()
            # nothing to close is the usual case, and is not looked for down the stack
            for k in range(len(stack) - 1, 0, -1) if opened["p"] > 0 or limits and opened[name] > 0 else ():
                if stack[k][0] == "p" or limits and stack[k][0] == name:
                    cut(k)
                    break
                if stack[k][0] in limits or not limits and stack[k][0] in BLOCK:
                    break
            if inner == zone:  # the parent may have changed
                inner = stack[-1][1]
        elif inner == zone:
            continue  # inline elements matter only where they change the zone
        else:
            flush()
        if name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append((name, inner))
            opened[name] += 1
    flush()
    return out


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys and their dense ranks from 1."""
    order = np.argsort(keys)
    ordered = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return order, rank


def suffix_order(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first `length` tokens, and each suffix's rank; suffixes of equal
    rank share those tokens. Every pass sorts by as many known ranks as fit a 62-bit key, at
    least two, so the sorted prefix at least doubles."""
    order, rank = _ranked(tokens)
    have = 1
    while have < length:
        bits = int(rank.max()).bit_length()
        key, reach = rank, have
        for _ in range(max(1, 62 // bits - 1)):
            if reach >= length:
                break
            step = min(reach, length - have)
            after = np.zeros_like(rank)  # past the end: sorts first
            after[: max(0, len(rank) - step)] = rank[step:]
            key, reach = key << bits | after, step + have
        order, rank = _ranked(key)
        have = reach
    return order, rank


def _spread(stream: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For every position, on how many owners its run of `length` tokens is."""
    _, rank = suffix_order(stream, length)
    pairs = np.unique(np.stack([rank, owner]), axis=1)
    return np.bincount(pairs[0], minlength=rank.max() + 1)[rank]


def _cover(starts: np.ndarray, size: int, length: int) -> np.ndarray:
    """Tokens inside the runs of `length` that begin at `starts`."""
    marks = np.zeros(size + 1, np.int64)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + length, -1)
    return np.cumsum(marks[:-1]) > 0


def least_pages(contents: int) -> int:
    """On how many contents of a host a run of RUN tokens is boilerplate."""
    return max(LEAST, int(np.ceil(SHARE * contents)))


def without(main: list[str], short: np.ndarray, long: np.ndarray) -> str:
    """The blocks of a page's main text without the runs of RUN tokens from `short` and of LONG
    tokens from `long`."""
    split = [t.split(" ") for t in main]
    sizes = [len(t) for t in split]
    hit = _cover(short, sum(sizes), RUN) | _cover(long, sum(sizes), LONG)
    if hit.sum() > MOST * len(hit):
        hit[:] = False
    ends = np.cumsum(sizes)
    kept = (" ".join(t for t, h in zip(tokens, hit[e - len(tokens) : e]) if not h) for tokens, e in zip(split, ends))
    return "\n".join(t for t in kept if t)


def zones(page: str | None) -> tuple[str | None, list[str], list[str]]:
    """The page's body, None without one, its unmarked blocks and its named surroundings. A
    headline outside of all surroundings belongs to the body."""
    found = blocks(page)
    marked = any(z == BODY for z, _ in found)
    body = "\n".join(t for z, t in found if z in (BODY, HEAD)) if marked else None
    rest = [t for z, t in found if z == REST or z == HEAD and not marked]
    return body, rest, [t for z, t in found if z == NAMED]


def _parts(page: str | None) -> tuple[bool, tuple[str, str, str]]:
    """If the page has a body, and its main text, the unmarked text beside it and its surroundings,
    one block a line."""
    body, rest, named = zones(page)
    rest = "\n".join(rest)
    return body is not None, (rest if body is None else body, "" if body is None else rest, "\n".join(named))


def _key(parts: tuple[str, str, str]) -> bytes | None:
    """What names a page's content; None if it has no text at all."""
    text = next((t for t in parts if t), "").encode(errors="surrogatepass")
    return (b"r" if parts[0] else b"n") + hashlib.blake2b(text, digest_size=15).digest() if text else None


def extract_group(pages: list[str | None]) -> list[str]:
    """The main text of each page of one host, in memory."""
    parsed = [_parts(p)[1] for p in pages]
    contents: dict[bytes, tuple] = {}
    for parts in parsed:
        if (key := _key(parts)) is not None:
            contents[key] = min(contents.get(key, parts), parts, key=lambda c: [t.encode(errors="surrogatepass") for t in (c[2], c[1])])
    stream, owner, first, ids = [], [], {}, {}
    for k, (key, parts) in enumerate(contents.items()):
        first[key] = len(stream)
        for part in parts:
            stream += [ids.setdefault(t, len(ids)) for t in part.split()]
            stream.append(-len(stream) - 1)  # separators are tokens of their own
        owner += [k] * (len(stream) - len(owner))
    found = {n: _spread(np.array(stream), np.array(owner), n) for n in (RUN, LONG)} if stream else {}
    texts = []
    for parts in parsed:
        main = parts[0]
        if main:
            at, n = first[_key(parts)], len(main.split())
            main = without(
                main.split("\n"),
                np.flatnonzero(found[RUN][at : at + n] >= least_pages(len(contents))),
                np.flatnonzero(found[LONG][at : at + n] >= LONG_PAGES),
            )
        texts.append(main)
    return texts


def _parse(part: pa.RecordBatch) -> dict:
    """What the host's order needs of a page, and its main text."""
    found = [_parts(p) for p in part.column("html").to_pylist()]
    column = lambda k: pa.array([parts[k] for _, parts in found], pa.string())
    size = lambda k: pa.array([len(parts[k].split()) for _, parts in found], pa.int32())
    return {
        **{c: part.column(c) for c in ("page_id", "url", "host", "row")},
        "marked": pa.array([marked for marked, _ in found], pa.bool_()),
        "main": column(0), "beside": column(1), "named": column(2), "n_main": size(0), "n_beside": size(1),
        "owner": pa.array([_key(parts) for _, parts in found], pa.binary()),
    }


def prefixes() -> list[int]:
    """By how many tokens the rounds sort: twice as many as before, RUN and LONG among them."""
    lengths = [1]
    while lengths[-1] < LONG:
        lengths.append(min(2 * lengths[-1], RUN if lengths[-1] < RUN else LONG))
    return lengths


def _grouped(row: np.ndarray, keys: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """One entry of every distinct (row, *keys), and the places of each."""
    order = np.lexsort((at, *keys[::-1], row))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for column in (row, *keys):
        new[1:] |= column[order[1:]] != column[order[:-1]]
    begin = np.flatnonzero(new)
    return order[begin], lists(at[order], np.append(begin, len(order)))


def _hashed(part: pa.RecordBatch, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of every run of RUN tokens of the streams, and if it is in the main text; runs
    of different hosts differ. The low bits are the number of contents that the host `need`s."""
    salt = part.column("salt").to_numpy().view(np.uint64)
    need = part.column("need").to_numpy().astype(np.uint64) - np.uint64(LEAST)
    before, out = np.zeros(part.num_rows, np.int64), []
    for name in ("main", "beside", "named"):
        data, offsets = buffer(part.column(name))
        words = Words(data, offsets)
        runs, begin = shingles(words.hashes(data), words.first, RUN)
        row = np.repeat(np.arange(part.num_rows), np.diff(begin))
        runs = mix(runs ^ salt[row]) >> np.uint64(64 - bits) << np.uint64(NEED_BITS) | need[row]
        out.append((row, np.arange(len(row)) - begin[row] + before[row], runs, np.full(len(row), name == "main")))
        before += words.counts
    return tuple(np.concatenate(x) for x in zip(*out))


def _packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted values by their differences, whose high bytes are mostly nought, and counts below 256."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.uint8).tobytes(), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(9, -1)
    return np.cumsum(np.ascontiguousarray(planes[:8].T).view("<u8").ravel(), dtype=np.uint64), planes[8]


def repeated(streams: DataFrame, tokens: int) -> DataFrame:
    """`streams` (`marked`, `main`, `beside`, `named`, `salt`, `need`; `tokens` in all main texts) with the
    places `repeats` of marked ones where a run of RUN tokens begins whose hash is on the `need`ed
    contents or more, and in a main text.

    Hashes are as long as makes one in four meet another, and are moved sorted, by the steps between
    them: about a byte each."""
    bits = min(60, max(16, math.ceil(math.log2(tokens + 1)) + 2))
    parts = max(2 * streams.sparkSession.sparkContext.defaultParallelism, math.ceil(tokens / TOGETHER))
    bounds = np.array([(k << bits + NEED_BITS) // parts for k in range(parts + 1)], np.uint64)

    def counted(batches):
        held, size = [], 0

        def close():
            runs = np.concatenate(held)
            held.clear()
            runs.sort()
            begin = np.flatnonzero(np.diff(runs >> ONE, prepend=~runs[:1] >> ONE))
            counts = np.minimum(np.diff(begin, append=len(runs)), LONG_PAGES)  # more says nothing
            counts |= IN_MAIN * np.bitwise_or.reduceat((runs & ONE).astype(np.uint8), begin).astype(np.int64)
            values = runs[begin] >> ONE
            cuts = np.searchsorted(values, bounds)
            used = [k for k in range(parts) if cuts[k] < cuts[k + 1]]
            blobs = [_packed(values[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]) for k in used]
            return pa.record_batch([pa.array(used, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "runs"])

        for batch in batches:
            for part in slices(batch, "main"):
                row, _, runs, main = _hashed(part, bits)
                order = np.lexsort((~main, runs, row))
                row, runs, main = row[order], runs[order], main[order]
                new = np.ones(len(runs), bool)  # a content counts once
                new[1:] = (runs[1:] != runs[:-1]) | (row[1:] != row[:-1])
                held.append(runs[new] << ONE | main[new])
                size += int(new.sum())
                if size >= TOGETHER:
                    yield close()
                    size = 0
        if size:
            yield close()

    def summed(table: pa.Table) -> pa.Table:
        found = [_unpacked(blob) for blob in table.column("runs").to_pylist()]
        values, at = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
        counts = np.concatenate([c for _, c in found])
        need = (values & np.uint64((1 << NEED_BITS) - 1)).astype(np.int64) + LEAST
        often = np.bincount(at, weights=counts & (IN_MAIN - 1)) >= need
        often &= np.bincount(at, weights=counts >= IN_MAIN) > 0
        return pa.table({"run": pa.array(values[often].view(np.int64))})

    blobs = tuned(streams.select("main", "beside", "named", "salt", "need")).mapInArrow(counted, "part int, runs binary")
    often = stored(blobs.groupBy("part").applyInArrow(summed, "run long"), "repeated")

    if often.count() * 8 <= BROADCAST_BYTES:
        columns = streams.columns
        known = streams.sparkSession.sparkContext.broadcast(np.sort(often.toPandas()["run"].to_numpy()))

        def mark(part: pa.RecordBatch) -> dict:
            row, at, runs, _ = _hashed(part, bits)
            hit = np.isin(runs.view(np.int64), known.value) & part.column("marked").to_numpy(zero_copy_only=False)[row]
            row, at = row[hit], at[hit]
            order = np.argsort(row, kind="stable")
            begin = np.searchsorted(row[order], np.arange(part.num_rows + 1))
            return {c: part.column(c) for c in columns} | {"repeats": lists(at[order], begin)}

        kind = ", ".join(f"{name} {kind}" for name, kind in streams.dtypes)
        return map_slices(streams, mark, f"{kind}, repeats array<bigint>", "main")

    def placed(part: pa.RecordBatch) -> dict:
        row, at, runs, _ = _hashed(part, bits)
        take = lambda c: part.column(c).take(pa.array(row))
        return {"host": take("host"), "owner": take("owner"), "at": pa.array(at), "run": pa.array(runs.view(np.int64))}

    places = map_slices(streams.where("marked"), placed, "host string, owner binary, at long, run long", "main")
    kept = places.join(often, "run", "left_semi").groupBy("host", "owner").agg(F.collect_list("at").alias("repeats"))
    return streams.join(kept, ["host", "owner"], "left")


def _tokens(part: pa.RecordBatch) -> dict:
    """Every distinct token of every stream with its places, of a marked page only those in a run from
    `repeats`. The unmarked text beside it begins LONG places after the main text, and surroundings LONG
    places after that, so no run reaches from one into the other."""
    data, offsets = buffer(part.column("joined"))
    words, raw = Words(data, offsets), data.tobytes()
    row = np.repeat(np.arange(part.num_rows), words.counts)
    at = np.arange(len(row)) - np.repeat(words.first[:-1], words.counts)
    n_main, n_beside = (part.column(c).to_numpy().astype(np.int64) for c in ("n_main", "n_beside"))
    repeats = part.column("repeats")
    begin = np.repeat(words.first[:-1], repeats.value_lengths().fill_null(0).to_numpy()) + repeats.flatten().to_numpy()
    marked = part.column("marked").to_numpy(zero_copy_only=False)
    enter = np.flatnonzero(~marked[row] | _cover(begin, len(row) + RUN, RUN)[: len(row)])
    at += LONG * ((at >= n_main[row]).astype(np.int64) + (at >= (n_main + n_beside)[row]))
    row, at = row[enter], at[enter]
    texts = pa.array([raw[b:e] for b, e in zip(words.starts[enter].tolist(), words.ends[enter].tolist())], pa.binary()).dictionary_encode()
    token = texts.indices.to_numpy().astype(np.int64)
    one, places = _grouped(row, [token], at)
    return {
        "host": part.column("host").take(pa.array(row[one])),
        "owner": part.column("owner").take(pa.array(row[one])),
        "key": texts.dictionary.take(pa.array(token[one])),
        "places": places,
    }


def _doubled(step: int):
    """Every distinct pair of known ranks `step` places apart, with its places."""

    def pairs(part: pa.RecordBatch) -> dict:
        runs = part.column("runs")
        row = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy())
        at, rank = np.divmod(runs.flatten().to_numpy(), 1 << RANK_BITS)
        where = row * (int(at.max(initial=0)) + step + 1) + at  # no row reaches into the next
        order = np.argsort(where)
        row, rank, at, where = row[order], rank[order], at[order], where[order]
        second = np.searchsorted(where, where + step)
        fit = np.flatnonzero(where[np.minimum(second, len(where) - 1)] == where + step)
        row, at, keys = row[fit], at[fit], [rank[fit], rank[second[fit]]]
        one, places = _grouped(row, keys, at)
        return {
            "host": part.column("host").take(pa.array(row[one])),
            "owner": part.column("owner").take(pa.array(row[one])),
            "r0": pa.array(keys[0][one]),
            "r1": pa.array(keys[1][one]),
            "places": places,
        }

    return pairs


def _finish(part: pa.RecordBatch) -> dict:
    positions = lambda c: (np.array(v or [], np.int64) for v in part.column(c).to_pylist())
    mains = part.column("main").to_pylist()
    texts = [without(m.split("\n"), s, n) if len(s) or len(n) else m for m, s, n in zip(mains, positions("short"), positions("long"))]
    return {
        "page_id": part.column("page_id"),
        "url": part.column("url"),
        "text": pa.array(texts, pa.string()),
        "n_chars": pa.array([len(t) for t in texts], pa.int64()),
    }


def _classes(runs: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Runs that are on `least` contents of a host or more, with the number of `pages`."""
    # summed in each task first: a run of any share of the pages is one row per task
    return runs.groupBy("host", *keys).agg(F.count("*").alias("pages")).where(F.col("pages") >= least)


def ordered(streams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`host`, `owner`, `at` and `pages` of the places of all streams (`host`, `owner`, `joined`,
    `n_main`, `n_beside`, `marked`, `repeats`) where a run of RUN tokens begins that is on LEAST contents of the host or more, and
    of LONG tokens on LONG_PAGES."""
    runs, keys = map_slices(streams, _tokens, "host string, owner binary, key binary, places array<bigint>", "joined"), ["key"]
    found = {}
    for have, goal in zip(prefixes(), [*prefixes()[1:], None]):
        runs = stored(runs, "runs", "zstd")
        # what is on fewer contents needs no further order
        classes = _classes(runs, keys, LEAST if have <= RUN else LONG_PAGES)
        if goal:
            classes = dense_positions(classes, ["host", *keys], "rank")
        ranked = runs.join(classes, ["host", *keys])
        if have in (RUN, LONG):
            ranked = stored(ranked.drop(*keys), "ranked")
            found[have] = ranked.select("host", "owner", F.explode("places").alias("at"), "pages")
        if goal:
            if have >= RUN:
                ranked = ranked.where(F.col("pages") >= LONG_PAGES)
            # a page's runs are as many as its tokens; a place and its rank are one number
            held = ranked.select("host", "owner", "rank", F.explode("places").alias("at"))
            held = held.groupBy("host", "owner").agg(F.collect_list(F.col("at") * (1 << RANK_BITS) + F.col("rank")).alias("runs"))
            kind = "host string, owner binary, r0 long, r1 long, places array<bigint>"
            runs, keys = map_slices(held.withColumn("size", F.lit("")), _doubled(goal - have), kind, "size"), ["r0", "r1"]
    return found[RUN], found[LONG]


def extract(pages: DataFrame) -> DataFrame:
    """`page_id`, `url`, `text`, `n_chars` of every page (`page_id`, `url`, `html`)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    kinds = dict(pages.select("page_id", "url").dtypes)
    ids = f"page_id {kinds['page_id']}, url {kinds['url']}"
    rows = pages.select("page_id", "url", "html", host.alias("host")).withColumn("row", F.monotonically_increasing_id())
    kind = "marked boolean, main string, beside string, named string, n_main int, n_beside int, owner binary"
    parsed = stored(map_slices(rows, _parse, f"{ids}, host string, row long, {kind}", "html"), "pages", "zstd")
    # copies of a content differ beside the main text at most; of their texts only that moves
    seen = parsed.where("owner IS NOT NULL").groupBy("host", "owner").agg(
        F.min(F.struct("named", "beside", "row")).alias("s"), F.max("n_main").alias("n_main")
    )
    seen = stored(seen.select("host", "owner", "n_main", F.col("s.row").alias("row")), "contents")
    counts = stored(seen.groupBy("host").agg(F.count("*").alias("contents")), "counts")
    share = F.ceil(F.col("contents") * SHARE)
    need = counts.select("host", F.least(F.greatest(F.lit(LEAST), share), F.lit(LONG_PAGES)).alias("need"), F.xxhash64("host").alias("salt"))
    streams = parsed.join(bounded(seen.select("row")), "row", "left_semi").join(bounded(need), "host")

    tokens = seen.agg(F.sum("n_main")).first()[0] or 0
    joined = F.concat_ws("\n", "main", "beside", "named").alias("joined")
    runs, long = ordered(
        repeated(streams, tokens).select("host", "owner", "marked", "n_main", "n_beside", "repeats", joined)
    )
    short = runs.join(counts, "host").where(F.col("pages") >= share).select("host", "owner", "at")
    long = long.select("host", "owner", "at")
    place = lambda which: F.collect_list(F.when(which & (F.col("at") < F.col("n_main")), F.col("at")))
    marks = (
        short.withColumn("long", F.lit(False)).unionByName(long.withColumn("long", F.lit(True)))
        .join(seen.select("host", "owner", "n_main"), ["host", "owner"]).groupBy("host", "owner")
        .agg(place(~F.col("long")).alias("short"), place(F.col("long")).alias("long"))
        .where("size(short) > 0 OR size(long) > 0")
    )
    cut = parsed.select("page_id", "url", "host", "owner", "main").join(bounded(stored(marks, "marks")), ["host", "owner"], "left")
    return map_slices(cut, _finish, f"{ids}, text string, n_chars long", "main")
