"""HTML extraction by equivalence-class template deduction.

A page is a sequence of tokens (tags and words), each told apart by its path of open elements. Tokens that occur
equally often on every page of a host share an occurrence vector and form an equivalence class. A class is valid
if it is large and frequent and, with `by_position`, ordered and nested: its tokens follow each other in one order on
every page, round by round, and it stands in one gap of each class that it meets. A class whose order varies is broken
into ordered ones, each large again; of two classes that aren't nested the less frequent goes. The valid classes are
the host's template.
What stands between template tokens are its slots. A block of text belongs to the article if it is filled from a
slot: words of the template itself (menus, notices, footers that repeat) go, and so do slots inside elements that
are page furniture by name. A host of under four pages has no template: there all blocks but furniture are slots, so one more page
on a host takes nothing from the others but what repeats.

Occurrences are added up over all pages of a host, however they are dealt: hosts over a bounded share of all bytes
are salted, tasks stream their pages and send sums by token, and the template is joined back to the pages. Order and
nesting are added up alike, in a reading each, for hosts where a class holds a block that may go.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, column, map_arrow
from tidemark.session import shuffle_partitions

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table "
    "tbody td template tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html", "head", "title", "option", "legend"}
_ITEM_SCOPE = {
    "li": ("li", {"ul", "ol", "menu"}),
    "dt": (("dt", "dd"), {"dl"}),
    "dd": (("dt", "dd"), {"dl"}),
    "tr": ("tr", {"table"}),
    "td": (("td", "th"), {"tr", "table"}),
    "th": (("td", "th"), {"tr", "table"}),
    "option": ("option", {"select"}),
}

#: Elements whose text is never part of an article.
FURNITURE_TAGS = frozenset("head nav header footer aside form button select textarea iframe noscript template menu dialog svg canvas object audio video".split())
#: Words in a class, id or role that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "sidebar side rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer foot copyright "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login popup modal overlay pagination pager tags toc skip search hidden complementary contentinfo dialog".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|</?([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass(frozen=True)
class TemplateRules:
    """Size of the output's chunks, and what makes a class large and frequent and a repeated block part of the template."""

    chunk_pages: int = 512
    chunk_chars: int = 8_000_000
    min_class_size: int = 3
    min_support: float = 0.5
    min_pages: int = 4
    block_share: float = 0.5
    by_position: bool = False
    hot_host_chars: int = 2_000_000
    hot_hosts: int = 500_000


class Block:
    """One block of text: its path, raw text, whether furniture surrounds it, which content roots hold it, and the tags before it."""

    __slots__ = ("path", "text", "furniture", "roots", "at")

    def __init__(self, path: str, text: str, furniture: bool, roots: tuple, at: int):
        self.path, self.text, self.furniture, self.roots, self.at = path, text, furniture, roots, at


def _is_furniture(tag: str, attributes: str) -> bool:
    if tag in FURNITURE_TAGS:
        return True
    if not attributes or "=" not in attributes or tag in ("html", "body", "article", "main"):
        return bool(attributes) and tag not in ("html", "body") and bool(re.search(r"\shidden\b", attributes))
    for found in _NAMES.finditer(attributes):
        value = (found[1] or found[2] or found[3] or "").lower()
        if not FURNITURE_WORDS.isdisjoint(_PARTS.findall(value)):
            return True
    return bool(_HIDDEN.search(attributes))


def read_page(source: str | None) -> tuple[list[tuple[str, str]], list[Block]]:
    """The tags with their paths, and the blocks of text with theirs, in page order."""
    tags: list[tuple[str, str]] = []
    blocks: list[Block] = []
    stack: list[tuple[str, bool, str]] = []  # element, inside furniture, path
    roots: list[int] = []
    run: list[str] = []
    serial = began = 0
    worded = False

    def path() -> str:
        return stack[-1][2] if stack else ""

    def flush() -> None:
        nonlocal worded
        worded = False
        if run:
            text = _SPACE.sub(" ", html_lib.unescape("".join(run))).strip()
            run.clear()
            if text:
                blocks.append(Block(path(), text, bool(stack) and stack[-1][1], tuple(roots), began))

    def close(at: int) -> None:
        for name, _, _ in stack[at:]:
            if name in ("article", "main"):
                roots.pop()
        del stack[at:]

    def close_last(names, stop) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                close(at)
                return
            if stack[at][0] in stop:
                return

    for found in _TOKEN.finditer(source or ""):
        tag = found[2]
        if tag is None:
            text = found[0]
            if text[0] != "<" or text == "<":
                run.append(text)
                if not worded and not text.isspace():
                    worded, began = True, len(tags)
            continue
        tag = tag.lower()
        if found[0][1] == "/":
            if tag in BLOCK:
                flush()
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][0] == tag:
                    tags.append((path(), "/" + tag))
                    close(at)
                    break
                if tag not in BLOCK and stack[at][0] in BLOCK:
                    break
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                close_last(("p",), {"div", "article", "section", "main", "body", "td", "li", "blockquote", "form", "aside", "nav", "table", "button"})
            if tag in _ITEM_SCOPE:
                names, stop = _ITEM_SCOPE[tag]
                close_last((names,) if isinstance(names, str) else names, stop)
            if tag == "body":
                close_last(("head",), ())
        attributes = found[3]
        tags.append((path(), tag))
        if tag in VOID or attributes.endswith("/"):
            continue
        above = stack[-1] if stack else ("", False, "")
        names = ".".join(sorted(_PARTS.findall(" ".join((m[1] or m[2] or m[3] or "").lower() for m in _NAMES.finditer(attributes))))) if "=" in attributes else ""
        stack.append((tag, above[1] or _is_furniture(tag, attributes), f"{above[2]}/{tag}{'#' + names if names else ''}"))
        if tag in ("article", "main"):
            serial += 1
            roots.append(serial)
    flush()
    return tags, blocks


def _digest(*parts: str | None) -> int:
    """64 bits of the parts, the same in all tasks, and never 0."""
    joined = "\0".join("\1" if x is None else x for x in parts).encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(joined, digest_size=8).digest(), "little", signed=True) or 1


_tag_token = lru_cache(65_536)(_digest)


def block_token(block: Block) -> int:
    return _digest(block.path, "=" + block.text)


def _body(blocks: list[Block]) -> int:
    """What tells one article from another: the long texts of a page, or all of them if none is long."""
    texts = [b.text for b in blocks if not b.furniture]
    return _digest(*([x for x in texts if len(x) > 200] or texts))


def page_sequence(tags: list[tuple[str, str]], blocks: list[Block]) -> list[int]:
    """The tokens of a page in its order."""
    out, done = [], 0
    for block in blocks:
        out += [_tag_token(*tag) for tag in tags[done : block.at]]
        out.append(block_token(block))
        done = block.at
    return out + [_tag_token(*tag) for tag in tags[done:]]


#: Of a token, or of a token beside one article: pages, occurrences, digest of the occurrence vector, size in tokens, articles,
#: and its place on the page of least digest that holds it, which is one page for all tokens of a class.
_SUMS = ("n", "total", "vector", "size", "bodies", "place")
#: The token that every page holds once.
_PAGE = 0


def page_tokens(page: str, tags: list[tuple[str, str]], blocks: list[Block]) -> dict[tuple[int, int], list[int]]:
    """The sums of one page by (token, article beside it; 0 for tags and furniture)."""
    body = _body(blocks)
    counts: Counter = Counter()
    sizes: dict = {}
    places: dict = {}
    block_at = {block.at + k: block for k, block in enumerate(blocks)}
    for at, token in enumerate(page_sequence(tags, blocks)):
        block = block_at.get(at)
        key = (token, 0 if block is None or block.furniture else body)
        counts[key] += 1
        places.setdefault(token, at)
        if block is not None:
            sizes[key] = block.text.count(" ") + 1
    # Two vectors are equal if the sums over pages of a random number for (page, count) are; 31 bits, so that sums fit.
    salt = _digest(page) | 1
    here = (salt >> 2 & 0x7FFFFFFF) << 32
    out = {k: [1, c, _share(salt, c), sizes.get(k, 1), int(k[1] != 0), here | places[k[0]]] for k, c in counts.items()}
    out[_PAGE, 0] = [1, 1, 0, 0, 0, 0]
    return out


def _share(salt: int, number: int) -> int:
    """A random number for (page, number)."""
    return ((salt * (2 * number + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF) >> 33


def _add(sums: dict, key, row: list[int]) -> None:
    held = sums.get(key)
    if held is None:
        sums[key] = list(row)
    else:
        for i in (0, 1, 2):
            held[i] += row[i]
        held[5] = min(held[5], row[5])


def least_pages(pages: int, rules: TemplateRules) -> float:
    return max(2, rules.min_support * pages)


def equivalence_classes(tokens: dict[int, list[int]], rules: TemplateRules) -> list[list[int]]:
    """The large and frequent classes of a host's tokens, whose sums are over all its pages; words of a block count one by one."""
    pages = tokens[_PAGE][0]
    classes: dict[tuple, list[int]] = defaultdict(list)
    for token, (n, total, vector, *_) in tokens.items():
        if token != _PAGE and pages >= rules.min_pages and n >= least_pages(pages, rules):
            classes[n, total, vector].append(token)
    return [c for c in classes.values() if sum(tokens[t][3] for t in c) >= rules.min_class_size]


def deduce(tokens: dict[int, list[int]], rules: TemplateRules) -> list[int] | None:
    """The blocks of a host's template, or None if it has too few pages for one."""
    pages = tokens[_PAGE][0]
    if pages < rules.min_pages:
        return None
    return sorted(t for members in equivalence_classes(tokens, rules) for t in members if _may_go(tokens[t], pages, rules))


def _may_go(row: list[int], pages: int, rules: TemplateRules) -> bool:
    """A block repeats as part of the template only beside different articles: copies of one article aren't a template."""
    return row[0] >= rules.block_share * pages and row[4] >= max(2, 0.5 * row[0])


#: A member of a class: its class's number, its token, pages, occurrences, size in words, and whether it is a block that may go.
_MEMBER = ("class", "token", "n", "total", "size", "goes")
_MEMBERS = "members array<struct<class: int, token: long, n: long, total: long, size: long, goes: boolean>>"


def candidates(tokens: dict[int, list[int]], rules: TemplateRules) -> list[tuple]:
    """The members of a host's large and frequent classes, each class in the order of one page; none if no block may go."""
    pages = tokens[_PAGE][0]
    classes = sorted((sorted(c, key=lambda t: (tokens[t][5], t)) for c in equivalence_classes(tokens, rules)), key=lambda c: (tokens[c[0]][5], c[0]))
    out = [(k, t, tokens[t][0], tokens[t][1], tokens[t][3], _may_go(tokens[t], pages, rules)) for k, members in enumerate(classes) for t in members]
    return out if any(m[5] for m in out) else []


def _by_class(members: list[tuple]) -> list[list[tuple]]:
    out: dict[int, list[tuple]] = defaultdict(list)
    for member in members:
        out[member[0]].append(member)
    return [out[k] for k in sorted(out)]


def class_places(members: list[tuple], sequence: list[int]) -> dict[int, list[tuple[tuple, list[int]]]]:
    """Of each class on a page, its members and their places."""
    of = {m[1]: [] for m in members}
    for at, token in enumerate(sequence):
        if (held := of.get(token)) is not None:
            held.append(at)
    out: dict[int, list] = defaultdict(list)
    for m in members:
        if of[m[1]]:
            out[m[0]].append((m, of[m[1]]))
    return out


def chains(members: list[tuple[tuple, list[int]]]) -> list[int]:
    """A number for each member of a class on one page; members of one number follow each other in the given order, round by round.

    Number 0 is the heaviest run in order by first places; the rest are laid on the run that ends latest before them.
    """
    firsts = [places[0] for _, places in members]
    if all(a < b for a, b in zip(firsts, firsts[1:])) and all(members[-1][1][i] < members[0][1][i + 1] for i in range(len(members[0][1]) - 1)):
        if all(x < y for (_, a), (_, b) in zip(members, members[1:]) for x, y in zip(a, b)):
            return [0] * len(members)
    found: list[int | None] = [None] * len(members)
    runs: list[tuple[list[int], list[int]]] = []  # first and last member's places

    def lay(k: int, run: int) -> bool:
        first, last = runs[run]
        own = members[k][1]
        if all(x < y for x, y in zip(last, own)) and all(x < y for x, y in zip(own, first[1:])):
            runs[run], found[k] = (first, own), run
            return True
        return False

    for k in _heaviest(firsts, [m[4] for m, _ in members]):
        if not runs:
            runs.append((members[k][1], members[k][1]))
            found[k] = 0
        else:
            lay(k, 0)
    ends: list[tuple[int, int]] = []  # last first place and number of each further run, rising
    for k in range(len(members)):
        if found[k] is None:
            at = bisect(ends, (firsts[k],)) - 1
            if at < 0 or not lay(k, ends[at][1]):
                found[k] = len(runs)
                runs.append((members[k][1], members[k][1]))
                ends.insert(at + 1, (firsts[k], found[k]))
            else:
                ends[at] = (firsts[k], ends[at][1])
    return found


def _heaviest(values: list[int], weights: list[int]) -> list[int]:
    """The rising subsequence of largest weight, by its indices."""
    best: list[tuple[int, int, int]] = []  # value at the end, weight, index: both rising
    before: list[int] = [-1] * len(values)
    for k, (value, weight) in enumerate(zip(values, weights)):
        at = bisect(best, (value,))
        total = weight
        if at:
            total, before[k] = total + best[at - 1][1], best[at - 1][2]
        end = at
        while end < len(best) and best[end][1] <= total:
            end += 1
        best[at:end] = [(value, total, k)]
    out, k = [], best[-1][2]
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def order_facts(members: list[tuple], salt: int, sequence: list[int], sums: Counter) -> None:
    """Add what tells the chains of each class on one page apart; members that have equal sums stand in one order on all pages."""
    for found in class_places(members, sequence).values():
        for (member, _), chain in zip(found, chains(found)):
            if chain:
                sums[member[1], 0, 0] += _share(salt, chain)


def ordered_classes(members: list[tuple], sums: dict[int, int], rules: TemplateRules) -> list[tuple]:
    """Each class broken by its members' sums; what is large stays."""
    out: list[tuple] = []
    number = 0
    for whole in _by_class(members):
        parts: dict[int, list[tuple]] = defaultdict(list)
        for member in whole:
            parts[sums.get(member[1], 0)].append(member)
        for part in parts.values():
            if sum(m[4] for m in part) >= rules.min_class_size:
                out += [(number, *m[1:]) for m in part]
                number += 1
    return out if any(m[5] for m in out) else []


def nesting_facts(members: list[tuple], salt: int, sequence: list[int], sums: Counter) -> None:
    """Count, by two classes and gap, how often the second stands in that gap of the first; gap 0: they cross."""
    spans = []
    for k, found in class_places(members, sequence).items():
        spans += [(places[0], places[-1], k, places) for places in zip(*(p for _, p in found))]
    open_: list[tuple] = []
    for span in sorted(spans):
        start, end, k, _ = span
        open_ = [s for s in open_ if s[1] > start]
        for _, last, outer, places in open_:
            gap = bisect(places, start)
            sums[outer, k, gap if end < last and bisect(places, end) == gap else 0] += 1
        open_.append(span)


def nested_blocks(members: list[tuple], sums: dict[tuple[int, int, int], int]) -> list[int]:
    """The blocks that may go of the classes that stand, nested, beside all more frequent ones that do."""
    classes = {c[0][0]: c for c in _by_class(members)}
    gaps: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for (outer, inner, gap), n in sums.items():
        gaps[outer, inner].append((gap, n))
    against: dict[int, set[int]] = defaultdict(set)
    for (outer, inner), found in gaps.items():
        # Nested: every occurrence of the inner class is in one gap of the outer.
        if len(found) > 1 or found[0][0] == 0 or found[0][1] != classes[inner][0][3]:
            against[outer].add(inner)
            against[inner].add(outer)
    kept: set[int] = set()
    for k in sorted(classes, key=lambda k: (-classes[k][0][2], -sum(m[4] for m in classes[k]), k)):
        if kept.isdisjoint(against[k]):
            kept.add(k)
    return sorted(m[1] for m in members if m[5] and m[0] in kept)


def extract(fixed: list[int] | None, blocks: list[Block]) -> str:
    """The article: all blocks filled from slots, in page order."""
    held = frozenset(fixed or ())
    return "\n".join(b.text for b in blocks if not b.furniture and (not held or block_token(b) not in held))


def _count_tokens(rules: TemplateRules):
    """In each task, by host: the sums of its tokens. A host that is here whole sends only what can be frequent."""

    def run(batches):
        key, sums, whole = None, {}, True

        def done():
            nonlocal sums, whole
            host, salts, pages, _ = key
            if whole and salts == 1:
                by_token: dict = {}
                for (token, _), row in sums.items():
                    if (held := by_token.get(token)) is not None:
                        held[4] += row[4]
                    _add(by_token, token, row)
                least = least_pages(by_token[_PAGE][0], rules)
                found = [(t, 0, row) for t, row in by_token.items() if t == _PAGE or row[0] >= least]
            else:
                found = [(t, body, row) for (t, body), row in sums.items()]
            sums, whole = {}, True
            n = len(found)
            return batch(
                host=pa.array([host] * n, pa.string()),
                salts=pa.array([salts] * n, pa.int32()),
                pages=pa.array([pages] * n, pa.int64()),
                token=pa.array([x[0] for x in found], pa.int64()),
                body=pa.array([x[1] for x in found], pa.int64()),
                **{name: pa.array([x[2][i] for x in found], pa.int64()) for i, name in enumerate(_SUMS)},
            )

        for part in batches:
            names = ("host", "salts", "pages", "salt", "page_id", "url", "html")
            for host, salts, pages, salt, page_id, url, source in zip(*(column(part, c) for c in names)):
                here = (host, salts, pages, salt)
                if sums and (here != key or len(sums) > 400_000):
                    cut = here == key
                    whole = whole and not cut
                    yield done()
                    whole = not cut
                key = here
                for token, row in page_tokens(f"{page_id} {url} {source}", *read_page(source)).items():
                    _add(sums, token, row)
        if sums:
            yield done()

    return run


def _deduce_hosts(rules: TemplateRules):
    def run(batches):
        for part in batches:
            rows = []
            for host, salts, tokens in zip(*(column(part, c) for c in ("host", "salts", "tokens"))):
                rows.append((host, salts, deduce({x["token"]: [x[c] for c in _SUMS] for x in tokens}, rules)))
            rows = [x for x in rows if x[2] is not None]
            yield batch(host=pa.array([x[0] for x in rows], pa.string()), salts=pa.array([x[1] for x in rows], pa.int32()), fixed=pa.array([x[2] for x in rows], pa.list_(pa.int64())))

    return run


def _candidate_hosts(rules: TemplateRules):
    def run(batches):
        for part in batches:
            rows = []
            for host, salts, tokens in zip(*(column(part, c) for c in ("host", "salts", "tokens"))):
                rows.append((host, salts, candidates({x["token"]: [x[c] for c in _SUMS] for x in tokens}, rules)))
            yield _members_batch([x for x in rows if x[2]])

    return run


_MEMBER_TYPE = pa.list_(pa.struct([("class", pa.int32()), ("token", pa.int64()), ("n", pa.int64()), ("total", pa.int64()), ("size", pa.int64()), ("goes", pa.bool_())]))


def _members_batch(rows: list[tuple]) -> pa.RecordBatch:
    members = [[dict(zip(_MEMBER, m)) for m in x[2]] for x in rows]
    return batch(host=pa.array([x[0] for x in rows], pa.string()), salts=pa.array([x[1] for x in rows], pa.int32()), members=pa.array(members, _MEMBER_TYPE))


def _members(value: list[dict]) -> list[tuple]:
    return [tuple(m[c] for c in _MEMBER) for m in value]


def _page_facts(add):
    """In each task, by host: what `add` counts on its pages, by three numbers."""

    def run(batches):
        key, members, sums = None, [], Counter()

        def done():
            n = len(sums)
            return batch(
                host=pa.array([key[0]] * n, pa.string()),
                **{name: pa.array([k[i] for k in sums], pa.int64()) for i, name in enumerate("abc")},
                value=pa.array(list(sums.values()), pa.int64()),
            )

        for part in batches:
            part = part.filter(part.column(part.schema.get_field_index("members")).is_valid())
            hosts, salts = column(part, "host"), column(part, "salt")
            held = part.column(part.schema.get_field_index("members"))
            for k, (page_id, url, source) in enumerate(zip(*(column(part, c) for c in ("page_id", "url", "html")))):
                if (hosts[k], salts[k]) != key:
                    if sums:
                        yield done()
                    key, members, sums = (hosts[k], salts[k]), _members(held[k].as_py()), Counter()
                add(members, _digest(f"{page_id} {url} {source}") | 1, page_sequence(*read_page(source)), sums)
        if sums:
            yield done()

    return run


def _judge_hosts(rules: TemplateRules, nesting: bool):
    """Classes with what was counted of them: the ordered ones, or the blocks of those that are nested too."""

    def run(batches):
        for part in batches:
            rows = []
            for host, salts, members, facts in zip(*(column(part, c) for c in ("host", "salts", "members", "facts"))):
                facts, members = facts or [], _members(members)
                if nesting:
                    rows.append((host, salts, nested_blocks(members, {(x["a"], x["b"], x["c"]): x["value"] for x in facts})))
                else:
                    rows.append((host, salts, ordered_classes(members, {x["a"]: x["value"] for x in facts}, rules)))
            rows = [x for x in rows if x[2]]
            if nesting:
                yield batch(host=pa.array([x[0] for x in rows], pa.string()), salts=pa.array([x[1] for x in rows], pa.int32()), fixed=pa.array([x[2] for x in rows], pa.list_(pa.int64())))
            else:
                yield _members_batch(rows)

    return run


def _judged(dealt: DataFrame, classes: DataFrame, add, rules: TemplateRules, nesting: bool, schema: str) -> DataFrame:
    """One reading of the pages of hosts with classes, and the classes judged by what it found."""
    # A left join keeps the dealt pages as they are, so that all readings are one exchange; tasks skip pages of other hosts.
    with_classes = dealt.join(_by_salt(classes), ["host", "salt"], "left")
    found = map_arrow(with_classes, _page_facts(add), "host string, a long, b long, c long, value long")
    summed = found.groupBy("host", "a", "b", "c").agg(F.sum("value").alias("value"))
    facts = summed.groupBy("host").agg(F.collect_list(F.struct("a", "b", "c", "value")).alias("facts"))
    return map_arrow(classes.join(facts, "host", "left"), _judge_hosts(rules, nesting), schema)


def _by_salt(hosts: DataFrame) -> DataFrame:
    """A row for each salt of a host."""
    return hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")


def _extract_pages(rules: TemplateRules):
    def run(batches):
        chunk, chars = [], 0

        def done():
            return batch(
                page_id=pa.array([x[0] for x in chunk], pa.int64()),
                url=pa.array([x[1] for x in chunk], pa.string()),
                text=pa.array([x[2] for x in chunk], pa.string()),
                n_chars=pa.array([len(x[2]) for x in chunk], pa.int64()),
            )

        for part in batches:
            for page_id, url, source, fixed in zip(*(column(part, c) for c in ("page_id", "url", "html", "fixed"))):
                chunk.append((page_id, url, extract(fixed, read_page(source)[1])))
                chars += len(chunk[-1][2])
                if len(chunk) >= rules.chunk_pages or chars >= rules.chunk_chars:
                    yield done()
                    chunk, chars = [], 0
        if chunk:
            yield done()

    return run


def main_text(pages: DataFrame, rules: TemplateRules = TemplateRules()) -> DataFrame:
    """page_id, url, text and n_chars of every row of `pages` (page_id, url, html).

    A null html gives an empty text; a null url is a host of its own; rows that repeat are read one by one and
    other columns are ignored; an empty table gives an empty result. Pages are read whole.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("host", host)
    size = rows.groupBy("host").agg(F.sum(F.length("html")).alias("chars"), F.count("*").alias("pages"))
    # At most hot_hosts hosts can hold over 1 / hot_hosts of all characters: the table that is broadcast is bounded.
    total = size.agg(F.sum("chars")).first()[0] or 0
    limit = max(rules.hot_host_chars, total // rules.hot_hosts)
    hot = size.where(F.col("chars") > limit).select("host", "pages", F.ceil(F.col("chars") / F.lit(rules.hot_host_chars)).cast("int").alias("salts"))
    salted = rows.join(F.broadcast(hot), "host", "left").select(
        "host", F.coalesce("salts", F.lit(1)).alias("salts"), F.coalesce("pages", F.lit(0)).alias("pages"), "page_id", "url", "html"
    )
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("salts")).cast("int"))
    dealt = salted.repartition(shuffle_partitions(pages.sparkSession), "host", "salt").sortWithinPartitions("host", "salt")

    schema = "host string, salts int, pages long, token long, body long, " + ", ".join(f"{c} long" for c in _SUMS)
    added = [F.sum(c).alias(c) for c in ("n", "total", "vector")] + [F.max("size").alias("size"), F.min("place").alias("place")]
    beside = map_arrow(dealt, _count_tokens(rules), schema).groupBy("host", "salts", "pages", "token", "body").agg(*added, F.max("bodies").alias("bodies"))
    tokens = beside.groupBy("host", "salts", "pages", "token").agg(*added, F.sum("bodies").alias("bodies"))
    # What is left of a host is bounded: at most 1 / min_support times the tokens of its mean page.
    frequent = tokens.where((F.col("token") == _PAGE) | ((F.col("n") >= 2) & (F.col("n") >= rules.min_support * F.col("pages"))))
    by_host = frequent.groupBy("host", "salts").agg(F.collect_list(F.struct("token", *_SUMS)).alias("tokens"))
    fixed, classes = "host string, salts int, fixed array<long>", f"host string, salts int, {_MEMBERS}"
    if rules.by_position:
        found = map_arrow(by_host, _candidate_hosts(rules), classes)
        ordered = _judged(dealt, found, order_facts, rules, False, classes)
        templates = _judged(dealt, ordered, nesting_facts, rules, True, fixed)
    else:
        templates = map_arrow(by_host, _deduce_hosts(rules), fixed)
    # All columns go on, so that all readings of the dealt pages are one exchange.
    return map_arrow(dealt.join(_by_salt(templates), ["host", "salt"], "left"), _extract_pages(rules), "page_id long, url string, text string, n_chars long")
