"""Crawl tables and links: upserts by URL, twins, resets, paging, redirects, retries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import urls
from siltstone.operators.relational import latest_value
from siltstone.storage import cut, forget

#: Priorities of node types, all over and within a subtree, what links are followed for, and redirect targets.
PRIORITIES = {"org_listing_url": 100.0, "org_unit": 90.0, "faculty_list_url": 80.0, "pagination_url": 70.0, "faculty_followup_url": 65.0, "detail_url": 50.0}
SUBTREE_PRIORITIES = {"faculty_list_url": 180.0, "pagination_url": 170.0, "faculty_followup_url": 165.0, "detail_url": 150.0}
LABEL_TYPES = {"detail": "detail_url", "pagination": "pagination_url", "followup": "faculty_followup_url", "reslice": "faculty_list_url"}
CN_SECOND_LEVEL = ["edu", "ac", "com"]
RETRY_BUDGET = 3
#: By what a find meets a person of another name, first to last, how many finds one task replays, and what these change.
CONTACTS = ("email", "homepage", "link")
HEAD = 300_000
_CHANGE = pa.schema([("contact", pa.string()), ("value", pa.string()), ("unit", pa.int64()), ("row", pa.int64()), ("person", pa.int64()), ("name", pa.string())])


def _of(table: dict, key: Column) -> Column:
    """A column's value in a small fixed table, null where it isn't there."""
    out = F.lit(None)
    for name, value in table.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def upsert_units(old: DataFrame, found: DataFrame) -> DataFrame:
    """Units (url, name, kind, found_on) with finds (url, name, kind, found_on, at) put in: the last name wins, kind and origin only fill gaps."""
    present = lambda c: F.nullif(F.col(c), F.lit(""))
    news = found.groupBy("url").agg(
        F.max_by("name", F.struct("at", "name")).alias("n"), F.min_by(present("kind"), F.when(present("kind").isNotNull(), F.struct("at", "kind"))).alias("k"),
        F.min_by(present("found_on"), F.when(present("found_on").isNotNull(), F.struct("at", "found_on"))).alias("f"),
    )
    return old.join(news, "url", "full_outer").select("url", F.coalesce("n", "name").alias("name"), F.coalesce(present("kind"), "k").alias("kind"), F.coalesce(present("found_on"), "f").alias("found_on"))


def latest_pages(fetches: DataFrame, by: list[str]) -> DataFrame:
    """Page cache: of each URL the fetch greatest in ``by``, whole, nulls too."""
    return latest_value(fetches, ["url"], [c for c in fetches.columns if c != "url"], by)


def done_twins(nodes: DataFrame) -> DataFrame:
    """Nodes (id, url, status) with twin: the least other done node of the same page, whatever the scheme; null if there is none."""
    keyed = nodes.withColumn("_bare", urls.without_scheme(F.col("url")))
    # the two least done ids tell every node its least other one
    two = keyed.where("status = 'done'").groupBy("_bare").agg(F.min("id").alias("_first"))
    second = keyed.join(two, "_bare").where("status = 'done' AND id <> _first").groupBy("_bare").agg(F.min("id").alias("_second"))
    joined = keyed.join(two, "_bare", "left").join(second, "_bare", "left")
    return joined.withColumn("twin", F.when(F.col("_first") != F.col("id"), F.col("_first")).otherwise(F.col("_second"))).drop("_bare", "_first", "_second")


def reset_bad_snapshots(nodes: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detail nodes whose cached text is missing, white or flagged as an empty page start over; those cache rows go."""
    bad = F.col("text").isNull() | (F.btrim("text", F.lit("\t\n\r ")) == "") | F.coalesce(F.col("block_reason").startswith("terminal_unavailable:empty_page"), F.lit(False))
    detail = nodes.where("type = 'detail_url'").select("url")
    gone = cache.where(bad).select("url").join(detail, "url", "left_semi").distinct()
    marked = nodes.join(gone.withColumn("_bad", F.lit(True)), "url", "left").withColumn("_bad", F.coalesce("_bad", F.lit(False)) & (F.col("type") == "detail_url"))
    fresh = marked.withColumn("status", F.when(F.col("_bad"), F.lit("pending")).otherwise(F.col("status"))).withColumn("attempts", F.when(F.col("_bad"), 0).otherwise(F.col("attempts")))
    return fresh.select(nodes.columns), cache.join(gone, "url", "left_anti").select(cache.columns)


def node_key(kind: Column, url: Column, unit_id: Column, unit_name: Column) -> Column:
    """Key of a node: a unit by its id, else its name; anything else by its URL; null where that is missing."""
    unit = F.coalesce(F.concat(F.lit("org_unit:id:"), unit_id.cast("string")), F.concat(F.lit("org_unit:name:"), F.nullif(unit_name, F.lit(""))))
    return F.when(kind == "org_unit", unit).otherwise(F.concat(F.lit("url:"), F.nullif(url, F.lit(""))))


def unit_url(name: Column) -> Column:
    """Identity of a unit that has no page of its own."""
    return F.concat(F.lit("about:org_unit:"), name)


def priority(kind: Column, subtree: bool = False) -> Column:
    """Priority of a node by its type; below a unit that is crawled by itself its types come first."""
    everywhere = _of(PRIORITIES, kind)
    return F.coalesce(_of(SUBTREE_PRIORITIES, kind), everywhere) if subtree else everywhere


def materialised(links: DataFrame, most_depth: int, full: list[str] = ()) -> DataFrame:
    """Nodes to make of labelled links (owner, url, label, depth): type, depth and priority.

    Links without a known label, below ``most_depth``, or of list types under owners in ``full``, whose budget is used up, give none.
    """
    kind = _of(LABEL_TYPES, F.col("label"))
    rows = links.withColumn("type", kind).withColumn("depth", F.col("depth") + 1).where(F.col("type").isNotNull() & (F.col("depth") <= most_depth))
    if full:
        rows = rows.where(~(F.col("owner").isin(list(full)) & (F.col("type") == "faculty_list_url")))
    return rows.withColumn("priority", priority(F.col("type")))


def _directory(url: Column) -> Column:
    return F.concat(F.regexp_replace(urls.part(url, 3), "/[^/]*$", ""), F.lit("/"))


def numbered_pages(links: DataFrame, page: str = "page", target: str = "target", order: str = "ordinal") -> DataFrame:
    """Links to numbered pages of the same host and directory, each target once a page, with page_index."""
    here, there = F.col(page), F.col(target)
    index = urls.page_index(there)
    rows = links.where((urls.host(here) == urls.host(there)) & F.startswith(urls.part(there, 3), _directory(here)) & index.isNotNull())
    return rows.groupBy(page, target).agg(F.min(order).alias(order)).withColumn("page_index", index)


def followups(links: DataFrame, wanted: list[str], unwanted: list[str], most: int = 36) -> DataFrame:
    """The first ``most`` links of a page (page, target, anchor, ordinal) whose anchor says a wanted word and no unwanted one."""
    text = F.coalesce("anchor", F.lit(""))
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    rows = links.where((urls.host(F.col("page")) == urls.host(F.col("target"))) & (F.col("page") != F.col("target")) & says(wanted) & ~says(unwanted))
    once = rows.groupBy("page", "target").agg(F.min(F.struct("ordinal", "anchor")).alias("first"))
    rank = F.row_number().over(Window.partitionBy("page").orderBy("first.ordinal"))
    return once.withColumn("rank", rank).where(F.col("rank") <= most).select("page", "target", F.col("first.anchor").alias("anchor"), "rank")


def form_quoted(text: Column) -> Column:
    """Form encoding of UTF-8: letters, digits and * - . _ bare, a space as plus."""
    return F.url_encode(text)


def synthetic_url(url: Column, form: Column, field: Column, page: Column) -> Column:
    """Identity of a page that a form leads to: the URL's own pairs, then kind, form, field and page."""
    split = F.filter(F.split(urls.part(url, 4), "&"), lambda x: (x != "") & ~F.startswith(x, F.lit("__ycl_")))
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")
    read = lambda x: F.coalesce(F.try_url_decode(x), x)
    own = F.transform(split, lambda x: F.concat(form_quoted(read(F.substring_index(x, "=", 1))), F.lit("="), form_quoted(read(value(x)))))
    added = F.array(F.lit("__ycl_kind=form"), F.concat(F.lit("__ycl_form="), form_quoted(form)), F.concat(F.lit("__ycl_field="), form_quoted(field)), F.concat(F.lit("__ycl_page="), page.cast("string")))
    return F.concat(F.lower(urls.part(url, 1)), F.lit("://"), urls.host(url), urls.part(url, 3), F.lit("?"), F.array_join(F.concat(own, added), "&"))


def form_pages(anchors: DataFrame, current: Column) -> DataFrame:
    """Pages behind form anchors (url, form, field, page, goto): url, form, field, page_index, total_pages, synthetic_url.

    Where a form has a box to go to a page, all pages up to the greatest are there. Page 1 and the
    ``current`` one are left out.
    """
    groups = anchors.where("page > 0").groupBy("url", "form", "field").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.max("page").alias("total_pages"), F.bool_or("goto").alias("goto"))
    pages = F.when(F.col("goto"), F.sequence(F.lit(1).cast("long"), F.col("total_pages").cast("long"))).otherwise(F.col("pages").cast("array<long>"))
    rows = groups.select("url", "form", "field", "total_pages", F.explode(pages).alias("page_index")).where((F.col("page_index") > 1) & (F.col("page_index") != current))
    return rows.withColumn("synthetic_url", synthetic_url(F.col("url"), F.col("form"), F.col("field"), F.col("page_index")))


def merged_states(reported: DataFrame, parsed: DataFrame, key: str) -> DataFrame:
    """Both tables' states, one a ``key``: a reported one wins."""
    own = reported.select(parsed.columns)
    return own.unionByName(parsed.join(own.select(key), key, "left_anti").select(parsed.columns))


def crawl_summary(nodes: DataFrame) -> DataFrame:
    """One row: how many nodes there are by status."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("pending", "in_progress", "retry", "done", "failed", "skipped")]
    return nodes.agg(F.count(F.lit(1)).alias("total"), *counts)


def site_root(host: Column) -> Column:
    """Last two labels of a host, three below a second level of cn."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    deep = (n >= 3) & (F.try_element_at(labels, F.lit(-1)) == "cn") & F.try_element_at(labels, F.lit(-2)).isin(CN_SECOND_LEVEL)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), k), ".")
    return F.when(deep, last(3)).otherwise(last(2))


def same_crawl_site(a: Column, b: Column) -> Column:
    """Hosts of one site root; hosts of github.io must be equal; ports are never the same site."""
    x, y = urls.host(a), urls.host(b)
    own = lambda h: (h == "github.io") | F.endswith(h, F.lit(".github.io"))
    return ~urls.has_port(a) & ~urls.has_port(b) & (x != "") & (y != "") & F.when(own(x) | own(y), x == y).otherwise(site_root(x) == site_root(y))


def url_matches(a: Column, b: Column) -> Column:
    """Same host, path but for slashes at its end, and parameters in any order; the scheme says nothing."""
    path = lambda u: F.regexp_replace(urls.part(u, 3), "/+$", "")
    query = lambda u: F.array_join(F.array_sort(F.filter(F.split(urls.part(u, 4), "&"), lambda x: x != "")), "&")
    return ~urls.has_port(a) & ~urls.has_port(b) & (urls.host(a) != "") & (urls.host(a) == urls.host(b)) & (path(a) == path(b)) & (query(a) == query(b))


def redirect_kind(target: Column, asked: Column, wechat: list[str]) -> Column:
    """wechat, onsite or offsite; a target that is no URL is offsite."""
    return F.when(urls.host(target).isin(wechat), "wechat").when(F.coalesce(same_crawl_site(target, asked), F.lit(False)), "onsite").otherwise("offsite")


def funnel(outcome: Column, attempt: Column) -> Column:
    """What a failed fetch comes to: skip, fail or retry."""
    return F.when(outcome == "not_found", "skip").when(outcome == "rate_limited", "fail").when(attempt >= RETRY_BUDGET, "fail").otherwise("retry")


def backoff_ms(attempt: Column) -> Column:
    return F.least(F.lit(2000.0) * F.pow(F.lit(2.0), attempt - 1), F.lit(60000.0))


def save_people(found: DataFrame, head: int = HEAD) -> DataFrame:
    """(row, person) of finds (row, unit, name_key, email, homepage, link), saved one after another in order of row.

    A find is the person of that name in its unit, else the first one of its email, else of its homepage, else of its
    link; else a new person, named by the row. A person joins the unit of each find, keeps its first name, and
    takes what it lacks from later finds.

    What a find comes to hangs on three things that earlier finds did: which person owned its values then, whether a person of its name had joined its unit by a value,
    and whether a find of its name there had become a person. A find without values can do the last alone, so ``plain``, the first such find of a name in a unit, stands for them all.
    The others are short tables of changes in order of row. The first ``head`` finds with values are replayed one by one and give a guess of them; then all finds with values are
    settled at once by the guess (``_settled``) and the changes read off the result (``_learned``), until they are those it came from. Such a result is the replay's: the first find
    that differed would have had the same changes before it. Finds that changed something in any round are replayed by themselves for the next guess, while they are no more than ``head``;
    so a chain of changes is followed in one round, and another is needed only where finds come in that changed nothing before. Where there are more, what was read off is the guess.
    Each round settles at least the first find that was wrong.
    """
    found = found.select("row", "unit", "name_key", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in CONTACTS))
    bare = F.coalesce(*CONTACTS).isNull()
    same_name = Window.partitionBy("unit", "name_key", F.when(F.col("name_key").isNull(), F.col("row")))
    found = cut(found.withColumn("plain", F.min(F.when(bare & F.col("name_key").isNotNull(), F.col("row"))).over(same_name)), "finds")
    valued = found.where(~bare)
    total = valued.count()
    first = valued
    if total > head:  # sort no more rows than needed
        first = valued.where(F.col("row") <= valued.agg(F.percentile_approx("row", min(1.0, 1.2 * head / total), max(10_000, 100 * total // head))).first()[0])
    first = cut(first.orderBy("row").limit(head), "first")
    changes = _changes(cut(_replayed(first), "replayed"))
    if total <= head:
        return _settled(found, valued, True, *changes).select("row", "person")
    makers, live = _live(found, valued, first, changes[0])
    few = makers is first
    told = None
    while True:
        people = cut(_settled(live, makers, few, *changes), "people")
        taken, arrivals = _learned(people)
        forget(people)
        after = (_owners(taken), arrivals)
        if all(x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty() for x, y in zip(after, changes, strict=True)):
            return _settled(found, makers, few, *changes).select("row", "person")
        rows = taken.select("row").union(arrivals.select("row"))
        told = cut((rows if told is None else rows.union(told)).distinct(), "told")
        changes = _changes(cut(_in_turn(live.join(F.broadcast(told), "row", "left_semi")), "replayed")) if told.count() <= head else after


def _live(found: DataFrame, valued: DataFrame, first: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finds with values that may become persons while nobody owns their values, and those that may change anything, once the ``first`` are replayed.

    If the first finds leave no value without owner, later persons own nothing, as owners only change to earlier persons than any now. Then later finds that come to a
    person of their own name change nothing, unless an owner or an earlier person has that name. Else these are all finds with values.
    """
    c = F.col
    last = first.agg(F.max("row")).first()[0]
    each = F.inline(F.array(*(F.struct(F.lit(x).alias("contact"), c(x).alias("value")) for x in CONTACTS)))
    if not valued.select(each).where("value IS NOT NULL").distinct().join(owners, ["contact", "value"], "left_anti").isEmpty():
        return valued, cut(valued, "live")
    latest = owners.groupBy("contact", "value").agg(F.min("person").alias("person")).agg(F.max("person")).first()[0]
    early = found.where(c("row") <= latest).select("name_key").where("name_key IS NOT NULL").distinct().withColumn("early", F.lit(True))
    may = (c("row") <= last) | c("plain").isNull() | (c("plain") > c("row")) | c("early")
    return first, cut(valued.join(early, "name_key", "left").where(may).select(*valued.columns), "live")


def _replayed(found: DataFrame) -> DataFrame:
    """What the first finds change."""
    return _in_turn(found)


def _in_turn(found: DataFrame) -> DataFrame:
    """What few finds change, replayed by one task in order of row: owners with contact and value, arrivals without.

    Finds that are left out must change nothing that these hang on; ``plain`` stands for those without values.
    """

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, joined, owner, people = {}, set(), {}, {}
        for batch in batches:
            out = []
            for row, unit, name, plain, *values in zip(*(batch.column(c).to_pylist() for c in ("row", "unit", "name_key", "plain", *CONTACTS)), strict=True):
                mine = [(c, v) for c, v in zip(CONTACTS, values, strict=True) if v is not None]
                at, named = names.get((unit, name), (None, None)) if name is not None else (None, None)
                if plain is not None and plain < row and (at is None or plain < at):
                    named = plain
                person = named
                for key in mine:
                    person = owner.get(key) if person is None else person
                arrived = named is None and person is not None
                person = row if person is None else person
                own = people.setdefault(person, {"name": name})
                if named is None and own["name"] is not None:
                    names.setdefault((unit, own["name"]), (row, person))
                    if arrived and (unit, own["name"]) not in joined:
                        joined.add((unit, own["name"]))
                        out.append((None, None, unit, row, person, own["name"]))
                for c, v in mine:
                    if own.setdefault(c, v) == v and person < owner.get((c, v), person + 1):
                        owner[c, v] = person
                        out.append((c, v, None, row, person, own["name"]))
            yield pa.RecordBatch.from_pylist([dict(zip(_CHANGE.names, x, strict=True)) for x in out], _CHANGE)

    return found.repartition(1).sortWithinPartitions("row").mapInArrow(replay, "contact string, value string, unit long, row long, person long, name string")


def _changes(replayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owners and arrivals of a replay, sent to all tasks where they are joined: a find of at most ``HEAD`` changes four of them."""
    owned = F.col("contact").isNotNull()
    return F.broadcast(replayed.where(owned).drop("unit")), F.broadcast(replayed.where(~owned).drop("contact", "value"))


def _met(rows: DataFrame, owners: DataFrame) -> DataFrame:
    """``rows`` with the owner of their first value that has one, and with the latest owner of their values; nobody is later than all."""
    c, nobody = F.col, F.lit(2**63 - 1)
    for x in CONTACTS:
        of = owners.where(c("contact") == x).groupBy(c("value").alias(x)).agg(F.array_sort(F.collect_list(F.struct("row", "person", "name"))).alias("of"))
        before = F.filter("of", lambda o: o["row"] < c("row"))
        rows = rows.join(of, x, "left").withColumn(f"{x}_owner", F.try_element_at(before, F.lit(-1))).drop("of")
    met = F.coalesce(*(c(f"{x}_owner") for x in CONTACTS))
    newest = F.greatest(*(F.when(c(x).isNotNull(), F.coalesce(c(f"{x}_owner.person"), nobody)) for x in CONTACTS))
    return rows.select("row", "unit", "name_key", "plain", *CONTACTS, met.alias("met"), newest.alias("newest"))


def _settled(rows: DataFrame, makers: DataFrame, few: bool, owners: DataFrame, arrivals: DataFrame) -> DataFrame:
    """``rows`` of the finds with (person, name, arrived, open), given who owned what and who joined which unit by a value; ``makers`` are the finds with values that may meet nobody, ``few`` if they are no more than one task replays.

    ``open`` are finds with a value that nobody, or only a later person than theirs, owned: no other find can change an owner.
    """
    c = F.col
    made = _met(makers, owners).where("met IS NULL AND name_key IS NOT NULL").groupBy(c("unit").alias("made_unit"), c("name_key").alias("made_name")).agg(F.min("row").alias("made"))
    rows = _met(rows, owners).join(F.broadcast(made) if few else made, c("unit").eqNullSafe(c("made_unit")) & (c("name_key") == c("made_name")), "left")
    joined = arrivals.select(c("unit").alias("in_unit"), c("name").alias("joined_name"), c("row").alias("joined"), c("person").alias("joined_as"))
    rows = rows.join(joined, c("unit").eqNullSafe(c("in_unit")) & (c("name_key") == c("joined_name")), "left")
    rows = rows.withColumn("first", F.least("plain", "made"))
    known = F.coalesce(c("name_key").isNotNull() & (c("row") > F.least("first", "joined")), F.lit(False))
    person = F.when(known, F.when(c("first").isNull() | (c("joined") < c("first")), c("joined_as")).otherwise(c("first"))).when(c("met").isNotNull(), c("met.person")).otherwise(c("row"))
    name = F.when(~known & c("met").isNotNull(), c("met.name")).otherwise(c("name_key"))
    rows = rows.select("row", "unit", *CONTACTS, "newest", person.alias("person"), name.alias("name"), (~known & c("met").isNotNull()).alias("arrived"))
    return rows.withColumn("open", F.coalesce(c("newest") > c("person"), F.lit(False))).drop("newest")


def _learned(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What finds gave: (contact, value, row, person, name), the first value of each kind for persons with an open find, and arrivals (unit, row, person, name), the first in a unit."""
    c = F.col
    rows = people.join(people.where("open").select("person").distinct(), "person", "left_semi")
    each = F.inline(F.array(*(F.struct(F.lit(x).alias("contact"), c(x).alias("value")) for x in CONTACTS)))
    taken = rows.select("person", "row", "name", each).where("value IS NOT NULL").groupBy("person", "contact").agg(F.min("row").alias("row"), F.min_by(F.struct("value", "name"), "row").alias("own"))
    arrivals = people.where("arrived AND name IS NOT NULL").groupBy("unit", "name").agg(F.min("row").alias("row"), F.min_by("person", "row").alias("person"))
    return cut(taken.select("contact", "own.value", "row", "person", "own.name"), "taken"), cut(arrivals.select("unit", "row", "person", "name"), "arrivals")


def _owners(taken: DataFrame) -> DataFrame:
    """Of values taken, those whose owner changes: nobody, or only later persons, took them before."""
    earlier = F.min("person").over(Window.partitionBy("contact", "value").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return cut(taken.withColumn("earlier", earlier).where("earlier IS NULL OR person < earlier").drop("earlier"), "owners")


def filled(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """For each ``key`` the first value of each column that is there and not empty, in ``order``: records only fill gaps."""
    first = [F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct(*order))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*first)
