"""Plain versions of queries that have no SQL; test_oracle runs them against the queries' rows."""

import collections
import hashlib
import re
import uuid
from datetime import timedelta
from html.parser import HTMLParser

import duckdb

from siltstone.plans.stored import KINDS, PLANTED


def read(sf, sql):
    return duckdb.sql(re.sub(r"\b(FROM|JOIN) (\w+)", rf"\1 '{sf}/\2.parquet'", sql)).fetchall()


def org_unit_ids(rows, sf):
    want = {k: str(uuid.uuid5(uuid.NAMESPACE_URL, n.lower())) for k, n in read(sf, "SELECT n_nationkey, n_name FROM nation")}
    assert {r.n_nationkey: r.logical_id for r in rows} == want


def greedy_trim(rows, sf):
    contact = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b1[3-9][0-9]{9}\b|\+?[0-9]{1,3}[ -]\(?[0-9]{2,4}\)?[ -][0-9]{3,4}[ -]?[0-9]{3,4}")
    want, left = set(), collections.defaultdict(lambda: 200)
    for conv, turn, text in read(sf, "SELECT conv_id, turn, text FROM conversations ORDER BY conv_id, turn"):
        if contact.search(text or ""):
            continue
        cost, hit = len(text or "") // 4, " the " in (text or "").lower()
        if not hit and cost > left[conv]:
            continue
        left[conv] -= 0 if hit else cost
        want.add((conv, turn, hit, cost))
    got = {(r.subject_id, r.ordinal, r.hit, r.cost) for r in rows}
    assert got == want and any(h for _, _, h, _ in got) and not all(h for _, _, h, _ in got)


def plan_allocation(rows, sf):
    plans = collections.defaultdict(list)
    for order, weight, start in read(sf, "SELECT l_orderkey, l_quantity, CAST(o_orderdate AS DATE) FROM lineitem JOIN orders ON o_orderkey = l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"):
        plans[order].append((weight, start))
    want = set()
    for order, phases in plans.items():
        total, at, left = sum(w for w, _ in phases), 0, 60
        for i, (w, start) in enumerate(phases, 1):
            behind = len(phases) - i
            days = left if not behind else min(max(1, round(60 * w / total)), left - behind)
            first, last = start + timedelta(at), start + timedelta(at + days - 1)
            free = [last - timedelta(n) for n in range(days) if (last - timedelta(n)).isoweekday() != 7]
            want.add((order, i, str(first), str(last), str(free[0]) if free else None))
            at, left = at + days, left - days
    assert {(r.plan_id, r.ordinal, r.start, r.end, r.due) for r in rows} == want


def saved_people(rows, sf):
    people, names, owner, want = {}, {}, {}, {}
    for key, cust in read(sf, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey"):
        unit, name = key % 5, f"n{cust}"
        mine = {f: f"{p}{cust % m}" for f, n, m, p in (("email", 4, 997, "m"), ("homepage", 7, 991, "h"), ("link", 11, 983, "l")) if key % n == 0}
        found = [names.get((unit, name))] + [owner.get(x) for x in mine.items()]
        person = next((p for p in found if p is not None), key)
        own = people.setdefault(person, {"name": name})
        names.setdefault((unit, own["name"]), person)
        for f, v in mine.items():
            if own.setdefault(f, v) == v:
                owner[f, v] = min(person, owner.get((f, v), person))
        want[key] = person
    assert {r.row: r.person for r in rows} == want and len(set(want.values())) < len(want)


def markdown_sections(rows, sf):
    want, convs = set(), collections.defaultdict(list)
    for conv, turn, role, text in read(sf, "SELECT conv_id, turn, role, text FROM conversations ORDER BY conv_id, turn"):
        convs[conv].append((turn, role, text or ""))
    for conv, turns in convs.items():
        for i, (turn, role, text) in enumerate(turns, 2):
            body = text.strip(" \n\t")
            if body:
                want.add((f"{conv}.md", i, f"Conversation {conv} > {role} {turn}", hashlib.sha256(body.encode()).hexdigest()))
    own = re.compile(r"^ {0,3}(?:#{1,6}(?:\s|$)|(?:[-*_]\s*){3,}$|=+\s*$|```|~~~)", re.M)  # texts that hold headings or rules of their own are cut further
    simple = {f"{conv}.md" for conv, turns in convs.items() if not any(own.search(text) for _, _, text in turns)}
    got = {(r.doc_path, r.ordinal, r.heading_path, r.chunk_hash) for r in rows}
    assert {g for g in got if g[0] in simple} == {w for w in want if w[0] in simple} and len(simple) >= 0.9 * len(convs)
    assert {g[0] for g in got} == {w[0] for w in want}


def html_text(rows, sf):
    class Links(HTMLParser):
        def __init__(self):
            super().__init__()
            self.n, self.title, self.inside = set(), "", False

        def handle_starttag(self, tag, attrs):
            self.inside = tag == "title"
            if tag == "a" and dict(attrs).get("href"):
                self.n.add(dict(attrs)["href"])

        def handle_endtag(self, tag):
            self.inside = False

        def handle_data(self, data):
            self.title += data if self.inside else ""

    want = {}
    for page, html in read(sf, "SELECT page_id, html FROM pages"):
        p = Links()
        p.feed(html)
        want[page] = (" ".join(p.title.split()), len(p.n))
    assert {r.page_id: (r.title, r.n_links) for r in rows} == want
    assert all("track(" not in r.text and "margin:0" not in r.text for r in rows)


def normalized_multivalues(rows, sf):
    want = {d: list(dict.fromkeys([lang, source])) for d, lang, source in read(sf, "SELECT doc_id, lang, source FROM documents")}
    assert {r.doc_id: r["items"].split("；") for r in rows} == want


def role_classification(rows, sf):
    title = {"BUILDING": "professor", "AUTOMOBILE": "associate", "MACHINERY": "lecturer", "HOUSEHOLD": "technical"}
    for key, segment, balance in read(sf, "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"):
        r = next(x for x in rows if x.c_custkey == key)
        if segment in title:
            assert r.title_family == title[segment]
        if balance > 5000 and segment != "FURNITURE":
            assert (r.role_status, r.phd) == ("included", "confirmed")


def entity_resolution_replay(rows, sf):
    orders = read(sf, "SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders ORDER BY o_orderkey")
    by = {int(r.observation_id): r for r in rows}
    assert len(by) == len(orders)
    strong = {}
    for key, cust, kind, _ in orders:
        if kind == "1-URGENT":
            first = strong.setdefault(cust, by[key].entity_id)
            assert by[key].entity_id == first
        elif kind not in ("2-HIGH", "3-MEDIUM"):
            assert by[key].method == "new"


def complete_link_clusters(rows, sf):
    near = {k: (n, b) for k, n, b in read(sf, "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier")}
    for r in rows:
        assert {near[m][0] for m in r.members} == {r.kind} and len(r.members) > 1
        worst = min(round(1 - abs(near[a][1] - near[b][1]) / 1000, 6) for a in r.members for b in r.members if a < b)
        assert abs(worst - r.score) < 1e-6 and worst >= 0.7


def link_candidates(rows, sf):
    pages = len(read(sf, "SELECT page_id FROM pages"))
    assert sum(r.n for r in rows) >= pages and {r.outcome for r in rows} <= {"kept", "enriched", "duplicate", "offsite", "invalid"}


def timed_queue(rows, sf):
    from tests.test_queue import replayed

    commands = []
    for key, at, user, kind, day in read(sf, "SELECT event_id, epoch_us(ts) / 1e6, user_id, event_type, CAST(ts AS DATE) FROM events"):
        kind = KINDS[kind]
        commands.append((user % 10, at, key, kind, None if kind == "claim" else f"{user}/{day}", float(user % 5) if kind == "add" else 3.0))
    want = collections.Counter((q, item, state, n, reason) for q, _, item, state, n, _, reason in replayed(commands, lease=7200.0))
    assert collections.Counter((r.queue, r.item, r.state, r.attempts, r.reason) for r in rows) == want and len(want) > 100


def safety_inspection(rows, sf):
    from tests.test_safety import plain

    results = collections.defaultdict(lambda: ([], []))
    for conv, turn, role, text in read(sf, "SELECT conv_id, turn, role, coalesce(text, '') FROM conversations ORDER BY conv_id, turn"):
        text += f" {PLANTED[conv % len(PLANTED)]}" if turn < 2 else ""
        if role == "user":
            results[conv][0].append(("fact" if turn % 4 == 0 else "advice", text))
        else:
            results[conv][1].append(text)
    want = {c: plain((c, "competition" if c % 2 == 0 else "generic", None, c % 3 == 0, *r)) for c, r in results.items()}
    assert {r.conv_id: (r.status, r.category, [tuple(w) for w in r.warnings], [tuple(x) for x in r.claims], r.texts) for r in rows} == want


def quota_sample(rows, sf):
    from tests.test_sampling import greedy

    customers = read(sf, "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
    flags = lambda k, b, m: [n for n, on in (("debt", b < 0), ("rich", b > 9000), ("building", m == "BUILDING"), ("third", k % 3 == 0)) if on]
    all_rows = [(k, str(n), flags(k, b, m), hashlib.sha256(f"gold/{k}".encode()).hexdigest()) for k, n, b, m in customers]
    assert {r.c_custkey: r.why for r in rows} == greedy(all_rows, len(all_rows) // 2, 1, 10, ("7",))


def tokenized_profiles(rows, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, sha = Tokenizer.from_file(path), hashlib.sha256(open(path, "rb").read()).hexdigest()

    def bounded(text, budget):
        found = own.encode(text, add_special_tokens=False)
        return (text if len(found.ids) <= budget else text[: found.offsets[budget][0]]).strip()

    said = collections.defaultdict(list)
    for cust, what in read(sf, "SELECT o_custkey, o_orderpriority FROM orders ORDER BY o_orderkey"):
        said[cust].append(f"研究方向 {what}")
    want = {}
    for key, name, segment in read(sf, "SELECT c_custkey, c_name, c_mktsegment FROM customer"):
        fields = [("学校", bounded(name, 64)), ("学院", "学院"), ("职称", bounded(segment + "教授、博士生导师；" * 20, 64)), ("研究方向原文", bounded("\n".join(said[key]), 2048))]
        profile = "\n".join(f"{a}：{b}" for a, b in fields if b)
        want[key] = (profile, hashlib.sha256(f"baseline-v1\n{sha}\n{profile}".encode()).hexdigest(), len(own.encode(profile, add_special_tokens=False).ids))
    assert {r.entity_id: (r.profile, r.profile_hash, r.n_tokens) for r in rows} == want and all("导师；" * 20 not in p for p, _, _ in want.values())


class _Tree(HTMLParser):
    """A page as the tree of test_noise, its source texts as they are."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.root = ("", {}, [])
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        x = (tag, dict(attrs), [], self.get_starttag_text())
        self.open[-1][2].append(x)
        if tag not in ("meta", "link", "img", "br", "hr", "input"):
            self.open.append(x)

    def handle_endtag(self, tag):
        if any(x[0] == tag for x in self.open[1:]):
            while self.open.pop()[0] != tag:
                pass


def stripped_pages(rows, sf):
    from tests.test_noise import plain

    def elements(x):
        return 0 if isinstance(x, str) else sum(1 + elements(c) for c in x[2] if not isinstance(c, str))

    changed = 0
    got = {r.page_id: r for r in rows}
    pages = read(sf, "SELECT page_id, html FROM pages")
    for page, html in pages:
        tree = _Tree()
        tree.feed(html or "")
        root = next((x for x in tree.root[2] if x[0] == "html"), tree.root)
        left = plain(root[:3])
        assert (elements(left) < elements(root)) == (got[page].removed > 0)
        assert (got[page].n_chars < len(html or "")) == (got[page].removed > 0)
        changed += got[page].removed > 0
    assert len(got) == len(pages) and changed > 5


def research_statements(rows, sf):
    from siltstone.operators.gold import read_statements  # another splitter, sign by sign

    want = {(doc, i, x) for doc, text in read(sf, "SELECT doc_id, text FROM documents") for i, x in enumerate(read_statements(text))}
    assert {(r.doc_id, r.pos, r.text) for r in rows} == want and len(want) > 500
    assert all(r.hash == hashlib.sha256(r.text.encode()).hexdigest() for r in rows)


def publication_mentions(rows, sf):
    want = set()
    for doc, text in read(sf, "SELECT doc_id, text FROM documents"):
        seen = {}
        for part in re.split("[；\n]+", text or ""):
            part = re.sub(r"\s+", " ", part).strip(" ")
            if any(c.isalnum() for c in part):
                seen.setdefault(part.upper().lower(), part)
        for i, part in enumerate(seen.values()):
            dois = dict.fromkeys(re.sub(r"[.,;:，。；：\])}）]+$", "", d).lower() for d in re.findall(r'(?i)\b(10\.\d{4,9}/[^\s"<>]+)', part))
            years = dict.fromkeys(re.findall(r"(?<!\d)((?:19|20)\d{2})(?!\d)", part, re.A))
            want.add((doc, i, part, next(iter(dois)) if len(dois) == 1 else None, int(next(iter(years))) if len(years) == 1 else None, len(dois) > 1 or len(years) > 1))
    assert {(r.doc_id, r.pos, r.text, r.doi, r.year, r.needs_review) for r in rows} == want and len(want) > 500


def map_facets(rows, sf):
    from urllib.parse import urlsplit

    last, want = {}, {}
    pairs = lambda url: dict((x.split("=", 1) if "=" in x else (x, "")) for x in urlsplit(url).query.split("&") if x)
    for page, url in read(sf, "SELECT page_id, url FROM pages ORDER BY page_id"):
        host = (urlsplit(url).hostname or "").lower()
        if host in last:
            a, b = pairs(last[host]), pairs(url)
            want[page] = sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))
        last[host] = url
    assert {r.page_id: r.changed for r in rows} == want


class _Anchors(HTMLParser):
    """Links with their texts, the first of each target."""

    def __init__(self):
        super().__init__()
        self.found, self.now = {}, None

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.now = (dict(attrs)["href"].strip(), [])

    def handle_data(self, data):
        if self.now:
            self.now[1].append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.now:
            self.found.setdefault(self.now[0], " ".join("".join(self.now[1]).split()))
            self.now = None


def link_signals(rows, sf):
    from urllib.parse import urljoin, urlsplit

    want = {}
    for page, url, html in read(sf, "SELECT page_id, url, html FROM pages"):
        parser = _Anchors()
        parser.feed(html or "")
        found = {}
        for href, anchor in parser.found.items():
            found.setdefault(urljoin(url or "", href), anchor)
        for i, (target, anchor) in enumerate(found.items()):
            want[page, i] = (anchor, len([x for x in urlsplit(target).path.split("/") if x]))
    assert {(r.page_id, r.ordinal): (r.anchor, r.depth) for r in rows} == want and len(want) > 100


PLAIN = {
    f.__name__: f
    for f in (org_unit_ids, greedy_trim, plan_allocation, saved_people, markdown_sections, html_text, normalized_multivalues, role_classification, entity_resolution_replay, complete_link_clusters, link_candidates, timed_queue, safety_inspection, quota_sample, tokenized_profiles, stripped_pages, research_statements, publication_mentions, map_facets, link_signals)
}
