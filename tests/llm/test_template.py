import random
from collections import Counter, defaultdict

import pytest

from tidemark.llm.template import TemplateRules, chains, main_text, page_sequence, read_page

HEAD = "<!doctype html><html><head><title>t{n}</title><style>p{{}}</style></head><body><div class='top'><a href=/>Home</a><a href=/a>About</a></div>"
FOOT = "<div class='bottom'>All rights reserved</div><script>var a = '<p>no</p>';</script></body></html>"


def page(n):
    body = f"<div><p>Story {n} opens  with\n a &amp; line {n * 7} of its own.</p><p>Then it <b>goes</b> on for {n + 1} days &eacute;.</p></div>"
    return HEAD.format(n=n) + body + FOOT


def test_template_goes_and_slots_stay(spark):
    rows = [(n, f"http://a.example/{n}", page(n)) for n in range(12)]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n in range(12):
        assert got[n].text == f"Story {n} opens with a & line {n * 7} of its own.\nThen it goes on for {n + 1} days é."
        assert got[n].n_chars == len(got[n].text) and got[n].url == f"http://a.example/{n}"


def test_odd_pages(spark):
    rows = [(1, None, None, "h"), (2, "u", "", "h"), (2, "u", "", "h"), (3, "http://b/", "<article><p>One &lt; two</p><nav>no</nav></article><p>out</p>", "h"), (None, "http://b/", "plain text", None), (4, "http://c/", "<p>open <b>never closed" + " word" * 100_000, "h")]
    got = [(r.page_id, r.text) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()]
    assert len(got) == 6 and got.count((2, "")) == 2 and (1, "") in got and (3, "One < two\nout") in got and (None, "plain text") in got
    assert (4, "open never closed" + " word" * 100_000) in got
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_test_tables_keep_their_article(spark, tiny):
    table = spark.read.parquet(f"{tiny}/pages.parquet")
    got = main_text(table).collect()
    assert len(got) == table.count()
    assert sum(r.n_chars > 100 for r in got) >= 0.9 * len(got)
    assert not any("<script" in r.text or "</" in r.text for r in got)


NOTICE = "<div class='x1'>Please read these terms with care</div>"
SCHEMA = "page_id long, url string, html string"


def texts(spark, rows, **rules):
    return {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, SCHEMA), TemplateRules(**rules)).collect()}


def test_classes_decide_what_is_template(spark):
    """Without a large class nothing is template; a short value that many pages share by chance is no class of its own."""
    label = lambda n: "<p>News</p>" if n % 3 else "<p>Sport</p>"
    rows = [(n, f"http://a.example/{n}", f"<body>{NOTICE}{label(n)}<p>Story number {n} is here</p></body>") for n in range(12)]
    on, off = texts(spark, rows), texts(spark, rows, min_class_size=10**6)
    for n in range(12):
        rest = f"{'News' if n % 3 else 'Sport'}\nStory number {n} is here"
        assert on[n] == rest and off[n] == "Please read these terms with care\n" + rest


def test_all_slots_stay(spark):
    """Several articles, text beside them, table cells, nested blocks and a headline in its own div."""
    body = "<div><div>Head {n}</div></div>{notice}<article><p>One {n}</p></article><article><p>Two {n}</p></article><table><tr><td>Cell {n}</td><td>More {n}</td></tr></table><section>Part {n}<div>Deep {n}</div></section>"
    rows = [(n, f"http://a.example/{n}", f"<body>{body.format(n=n, notice=NOTICE)}<nav>no</nav></body>") for n in range(6)]
    got = texts(spark, rows)
    for n in range(6):
        assert got[n] == "\n".join(f"{x} {n}" for x in ("Head", "One", "Two", "Cell", "More", "Part", "Deep"))


def test_template_is_of_the_host_however_it_is_dealt(spark):
    """Hosts of 513 to 515 pages, salted ones and ones of large pages lose the same notices."""
    rows = [(n, f"http://a.example/{n}", f"<body>{NOTICE}<p>Story {n} of many</p></body>") for n in range(514)]
    whole = {n: f"Story {n} of many" for n in range(514)}
    assert texts(spark, rows) == whole
    assert texts(spark, rows, hot_host_chars=500, chunk_pages=3) == whole
    large = [(n, f"http://b.example/{n}", f"<body>{NOTICE}<p>Page {n}{' word' * 500_000}</p></body>") for n in range(5)]
    assert all(not t.startswith("Please") for t in texts(spark, large).values())


def test_copies_of_one_article_are_no_template(spark):
    copy = "<p>" + "The same long story again. " * 12 + "</p>"
    rows = [(n, f"http://a.example/{n}", f"<body>{NOTICE}{copy if n < 8 else f'<p>{n} ' + 'Another story. ' * 20 + '</p>'}</body>") for n in range(14)]
    for salted in ({}, {"hot_host_chars": 400}):
        got = texts(spark, rows, **salted)
        assert all("The same long story" in got[n] for n in range(8)) and all("Another story" in got[n] for n in range(8, 14))
        assert all(not t.startswith("Please") for t in got.values())


def plain_texts(rows):
    """What each page keeps, from whole occurrence vectors of all tokens of each host and no sums."""
    hosts, out = defaultdict(list), {}
    for page_id, url, html in rows:
        hosts[url.split("/")[2]].append((page_id, *read_page(html)))
    for pages in hosts.values():
        counts = [Counter([("tag", *t) for t in tags] + [("text", b.path, b.text) for b in blocks]) for _, tags, blocks in pages]
        inside = [[b for b in blocks if not b.furniture] for _, _, blocks in pages]
        bodies = [tuple([b.text for b in found if len(b.text) > 200] or [b.text for b in found]) for found in inside]
        classes = defaultdict(list)
        for token in set().union(*counts):
            vector = tuple(c[token] for c in counts)
            if sum(v > 0 for v in vector) >= max(2, 0.5 * len(pages)):
                classes[vector].append(token)
        fixed = set()
        for vector, members in classes.items():
            if len(pages) >= 4 and sum(t[2].count(" ") + 1 if t[0] == "text" else 1 for t in members) >= 3:
                for token in members:
                    held = [k for k, v in enumerate(vector) if v]
                    beside = {bodies[k] for k in held if any((b.path, b.text) == token[1:] for b in inside[k])}
                    if token[0] == "text" and len(beside) >= max(2, 0.5 * len(held)):
                        fixed.add(token[1:])
        for (page_id, _, _), found in zip(pages, inside):
            out[page_id] = "\n".join(b.text for b in found if (b.path, b.text) not in fixed)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_small_hosts_against_whole_vectors(spark, seed):
    draw, rows = random.Random(seed), []
    shared = [f"<div class='s{k}'>Shared words number {k} of this host</div>" for k in range(4)] + ["<p>Tip</p>", "<nav>Menu here</nav>", "<article>One <b>fixed</b> piece</article>"]
    for host in range(5):
        own = [f"<p>{' '.join(draw.choice('red blue green stone river'.split()) for _ in range(draw.randrange(1, 60)))}</p>" for _ in range(4)]
        for n in range(draw.randrange(1, 9)):
            parts = [p for p in shared if draw.random() < 0.8] + draw.sample(own, draw.randrange(0, 3)) + [f"<p>Page {n} of {host}</p>"] * draw.randrange(0, 2)
            draw.shuffle(parts)
            rows.append((len(rows), f"http://h{host}.example/{n}", f"<body>{''.join(parts)}</body>"))
    got = texts(spark, rows)
    assert got == plain_texts(rows)
    assert texts(spark, rows, hot_host_chars=300, chunk_pages=2) == got


def test_a_fourth_page_takes_repeats_only(spark):
    rows = [(n, f"http://a.example/{n}", f"<body>{NOTICE}<article><p>Story {n} is here</p></article><div>Beside {n}</div><p>{'Twice' if n < 2 else 'Once'}</p></body>") for n in range(4)]
    three, four = texts(spark, rows[:3]), texts(spark, rows)
    for n in range(3):
        assert three[n] == "Please read these terms with care\n" + four[n]
        assert four[n] == f"Story {n} is here\nBeside {n}\n{'Twice' if n < 2 else 'Once'}"


def test_copies_on_a_small_host_leave_its_template(spark):
    rows = [(n, f"http://a.example/{n}", f"<body>{NOTICE}<p>Story {max(n, 1)} is here</p></body>") for n in range(4)]
    assert texts(spark, rows) == {n: f"Story {max(n, 1)} is here" for n in range(4)}


def ordered_host(parts, pages=12, on=8):
    """Pages of one host, of which `on` hold the parts that `parts` gives for them."""
    return [(n, f"http://a.example/{n}", f"<body><p>Story {n} begins</p>{''.join(f'<p>{x}</p>' for x in (parts(n) if n < on else ()))}<p>Story {n} ends</p></body>") for n in range(pages)]


def taken(spark, rows):
    """The blocks beside stories that some page keeps, the same however pages are dealt."""
    got = texts(spark, rows, by_position=True)
    assert texts(spark, rows, by_position=True, hot_host_chars=200, chunk_pages=2) == got
    return {x for t in got.values() for x in t.split("\n") if not x.startswith("Story")}


def test_a_class_stands_in_one_order(spark):
    """Short blocks of one class are template in one order only; a part that keeps its order and is large stays a class."""
    assert taken(spark, ordered_host(lambda n: ["Tip", "Read on"])) == set()
    assert taken(spark, ordered_host(lambda n: ["Tip", "Read on"][:: 1 if n % 2 else -1])) == {"Tip", "Read on"}
    swapped = lambda n: (["One", "Two", "Three", "Four", "Five", "Six"] * 2)[3 * (n % 2) :][:6]
    assert taken(spark, ordered_host(swapped)) == set()
    moved = lambda n: (["Note", "One", "Two", "Three"], ["One", "Two", "Three", "Note"])[n % 2]
    assert taken(spark, ordered_host(moved)) == {"Note"}


def test_a_class_stands_in_one_gap_of_others(spark):
    outer = ["First part here", "Last part here"]
    within = lambda n: [outer[0], "Some small note"][: 2 if n < 7 else 1] + [outer[1]]
    assert taken(spark, ordered_host(within)) == set()
    inside_and_out = lambda n: (within(n), ["Some small note"] * (n < 7) + outer)[n % 2]
    assert taken(spark, ordered_host(inside_and_out)) == {"Some small note"}
    crossing = lambda n: ["First part here", "Left small note", "Last part here", "Right small note"] if n < 7 else outer
    assert taken(spark, ordered_host(crossing)) == {"Left small note", "Right small note"}


@pytest.mark.parametrize("rounds", (1, 2, 3))
def test_members_of_a_chain_follow_each_other(rounds):
    draw = random.Random(rounds)
    follows = lambda a, b: all(x < y for x, y in zip(a, b)) and all(y < x for x, y in zip(a[1:], b))
    broken = 0
    for _ in range(300):
        size = draw.randrange(1, 8)
        found = list(range(size)) * rounds
        for _ in range(draw.randrange(4)):
            i, j = draw.randrange(len(found)), draw.randrange(len(found))
            found[i], found[j] = found[j], found[i]
        places = [[at for at, x in enumerate(found) if x == k] for k in range(size)]
        numbers = chains([((0, k, 1, rounds, draw.randrange(1, 5), True), p) for k, p in enumerate(places)])
        assert all(follows(places[a], places[b]) for b in range(size) for a in range(b) if numbers[a] == numbers[b])
        whole = all(follows(places[a], places[b]) for b in range(size) for a in range(b))
        assert not whole or not any(numbers)
        broken += not whole
    assert broken > 100


def test_sequence_of_a_page_is_its_order():
    tags, blocks = read_page("<body> \n<b>One</b> two<div>three</p>four<br>five</div>six</body>")
    assert [b.at for b in blocks] == [2, 4, 4, 5] and [b.text for b in blocks] == ["One two", "three", "four five", "six"]
    assert len(page_sequence(tags, blocks)) == len(tags) + len(blocks) == 10
