"""Hand-made cases: merges, walks, searches, imports and streams."""

import json

from pyspark.sql import functions as F

from parley.functions import ids, text
from parley.operators import audit, fingerprints, graph, joins, links, lookups, merge, search, windows
from parley.sources import readers, writers
from parley.sources.schemas import UPDATES
from parley.streaming import feed

MESSAGE = "peer_id long, message_id long, date long, sender_id long, text string, state string, reply_to_msg_id long, reply_to_peer_id long, edit_date long"


def messages(spark, *rows):
    return spark.createDataFrame([tuple(r) + (None,) * (9 - len(r)) for r in rows], MESSAGE)


def test_edit_chain_keeps_every_version(spark):
    base = messages(spark, (1, 5, 100, 7, "one", "active"))
    changes = messages(spark, (1, 5, 100, 7, "two", "edited"), (1, 5, 100, 7, "three", "edited")).withColumn("seq", F.when(F.col("text") == "two", 1).otherwise(2).cast("long"))
    now, revisions = merge.merge_messages(base, changes)
    assert [r.text for r in now.collect()] == ["three"]
    assert [(r.text, r.revision_no) for r in revisions.orderBy("revision_no").collect()] == [("one", 1), ("two", 2)]


def test_state_alone_makes_no_revision_and_merges_are_idempotent(spark):
    base = messages(spark, (1, 5, 100, 7, "one", "active"))
    change = messages(spark, (1, 5, 100, 7, "one", "deleted")).withColumn("seq", F.lit(1).cast("long"))
    now, revisions = merge.merge_messages(base, change)
    assert revisions.count() == 0
    again, _ = merge.merge_messages(now, change)
    assert again.collect() == now.collect()


def test_equal_message_ids_of_two_chats_stay_apart_and_ambiguous_deletes_delete_nothing(spark):
    rows = messages(spark, (1001, 777, 1, None, "a", "active"), (1002, 777, 1, None, "b", "active"), (1002, 778, 1, None, "c", "active"), (5, 779, 1, None, "d", "active"))
    peers = spark.createDataFrame([(1001, "user"), (1002, "user"), (5, "channel")], "peer_id long, peer_type string")
    gone = spark.createDataFrame([(777,), (778,), (779,)], "message_id long")
    found = {r.message_id: r.outcome for r in merge.classify_common_deletes(rows, peers, gone).collect()}
    assert found == {777: "ambiguous", 778: "delete", 779: "tombstone"}
    after = {(r.peer_id, r.message_id): (r.state, r.text) for r in merge.apply_common_deletes(rows, peers, gone).collect()}
    assert after[1002, 778] == ("deleted", "c") and after[1001, 777][0] == after[1002, 777][0] == after[5, 779][0] == "active"


def test_cycles_tails_and_chains(spark):
    chain = [(1, k, 1, None, "x", "active", k - 1 if k > 1 else None) for k in range(1, 40)]
    cycle = [(2, k, 1, None, "x", "active", k % 33 + 1) for k in range(1, 34)] + [(2, 100, 1, None, "x", "active", 5), (2, 200, 1, None, "x", "active", 200)]
    rows = messages(spark, *chain, *cycle)
    found = graph.walks(rows, 64)
    assert [tuple(r) for r in graph.reply_cycles(found, rows, 64).collect()] == [(2, 1, 33, 1)]
    assert max(r.depth for r in graph.deep_chains(found, 30, 64).collect()) == 38
    assert graph.reply_cycles(graph.walks(rows.where("peer_id = 1"), 8), rows.where("peer_id = 1"), 8).count() == 0
    assert [tuple(r) for r in graph.self_replies(rows).collect()] == [(2, 200)]


def test_walks_longer_than_most_hops(spark):
    """A chain of 100, a cycle of 50 and a tail of 30 into a cycle of two, looked at after 4 hops."""
    chain = [(1, k, 1, None, "x", "active", k - 1 if k > 1 else None) for k in range(1, 101)]
    cycle = [(2, k, 1, None, "x", "active", k % 50 + 1) for k in range(1, 51)]
    tail = [(3, k, 1, None, "x", "active", k - 1 if k > 1 else 2) for k in range(1, 33)]
    rows = messages(spark, *chain, *cycle, *tail)
    found = graph.walks(rows, 4)
    assert sorted((r.message_id, r.depth) for r in graph.deep_chains(found, 90, 4).collect()) == [(k, k - 1) for k in range(91, 101)]
    assert sorted(tuple(r) for r in graph.reply_cycles(found, rows, 4).collect()) == [(2, 1, 50, 0), (3, 1, 2, 30)]


def test_folding_finds_facade_and_prefixes_phrases_and_blank_queries(spark):
    rows = messages(spark, (1, 1, 1, None, "La façade est belle", "active"), (1, 2, 1, None, "facade only", "edited"), (1, 3, 1, None, "façade", "deleted"), (1, 4, 1, None, None, "active"))
    postings = search.build_postings(rows)
    assert {r.message_id for r in search.search(postings, "facade").collect()} == {1, 2}
    assert {r.message_id for r in search.search(postings, "fac* bel*").collect()} == {1}
    assert {r.message_id for r in search.phrase_matches(postings, "est belle").collect()} == {1}
    assert search.search(postings, "  ").count() == 0
    shown = rows.where("message_id = 1").select(search.snippet("text", ["façade"]).alias("s")).first().s
    assert shown == "La <b>façade</b> est belle"


def test_scores(spark):
    rows = spark.createDataFrame([(1, 1, "alpha beta", ["alpha", "beta"]), (1, 2, "beta then alpha", ["alpha", "beta", "then"]), (1, 3, "alphabet betas", ["alphabet", "betas"]), (1, 4, "gamma", ["gamma"])], "peer_id long, message_id long, text string, tokens array<string>")
    assert {r.message_id: r.score for r in search.score_entries(rows, "alpha beta").collect()} == {1: 100, 2: 50, 3: 20}


def test_links(spark):
    pages = spark.createDataFrame([("a/x.html", '<a href="../b.html#t">1</a><a href="../../c.html">2</a><a href="no.html">3</a><a href="https://e.org">4</a><a href="#in">5</a>'), ("b.html", '<i id="t"></i>')], "page string, html string")
    found = {r.href: r.reason for r in links.broken_links(links.extract_links(pages), pages, links.extract_anchors(pages)).collect()}
    assert found == {"../../c.html": "escapes_root", "no.html": "missing_page", "#in": "missing_anchor"}


def test_clean_archive_has_no_findings(spark):
    rows = messages(spark, (1, 1, 1700000000, 1, "x", "active"), (1, 2, 1700000001, 1, "y", "active", 1))
    peers = spark.createDataFrame([(1, "user")], "peer_id long, peer_type string")
    found = audit.audit(audit.Tables(messages=rows, peers=peers))
    assert found.count() == 0
    assert audit.overall_status(found).first().status == "passed"
    assert audit.finding_counts(found).agg(F.sum("n")).first()[0] == 0
    assert audit.schema_findings(spark, {"messages": ["text"], "peers": []}, {"messages": []}, 4, 5).count() == 3


def test_fingerprints_ignore_order(spark):
    rows = messages(spark, *[(1, k, k, 1, f"t{k}", "active") for k in range(20)])
    a, b = (fingerprints.dataset_fingerprint(r).first().fingerprint for r in (rows, rows.orderBy(F.desc("message_id")).repartition(3)))
    assert a == b != fingerprints.dataset_fingerprint(rows.where("message_id > 0")).first().fingerprint


def test_shards_and_albums(spark):
    rows = spark.createDataFrame([(p, k) for p in (3, 1, 5000) for k in range(7)], "peer_id long, message_id long")
    found = sorted((r.peer_id, r.message_id, r.shard_id) for r in windows.entry_shards(rows, 5).collect())
    assert [s for *_, s in found] == [k // 5 for k in range(21)]


def test_text_functions(spark):
    one = spark.range(1)
    row = one.select(text.slug(F.lit("  Été — 2024! ")).alias("slug"), text.utf16_slice(F.lit("a🙂bc"), F.lit(3), F.lit(2)).alias("cut"), text.format_size(F.lit(1536)).alias("size"), text.normalize_emoji(F.lit("❤x")).alias("emoji"), ids.parse_peer(F.lit("channel5")).alias("peer"), text.safe_href(F.lit("javascript:x")).alias("href"), text.relative_path(F.lit("a/b/x.html"), F.lit("a/c/y.html")).alias("rel")).first()
    assert tuple(row) == ("été_2024", "bc", "1.5 KB", "❤️x", -1_000_000_000_005, None, "../c/y.html")


def test_json_export(spark, tmp_path):
    chat = {"name": "Ann", "type": "personal_chat", "id": 9, "messages": [
        {"id": 1, "type": "message", "date_unixtime": "1700000000", "from": "Ann", "from_id": "user9", "text_entities": [{"type": "plain", "text": "🙂 hi "}, {"type": "bold", "text": "you"}], "reactions": [{"type": "emoji", "emoji": "👍", "count": 2}, {"type": "emoji", "emoji": " "}]},
        {"id": 2, "type": "message", "date_unixtime": "1700000060", "edited_unixtime": "1700000090", "from": "Me", "from_id": "user1", "reply_to_message_id": 1, "text_entities": [], "photo": "photos/p.jpg", "photo_file_size": 5},
        {"id": -3, "type": "service"}]}
    (tmp_path / "result.json").write_text(json.dumps({"personal_information": {"user_id": 1, "first_name": "Me", "last_name": ""}, "chats": {"list": [chat]}}))
    peers, rows, media = readers.read_export_json(spark, str(tmp_path / "result.json"), 5)
    one, two = rows.orderBy("message_id").collect()
    assert (one.text, json.loads(one.entities_json)[0]["offset"], json.loads(one.reactions_json)["results"][0]["count"]) == ("🙂 hi you", 6, 2)
    assert (two.state, two.reply_to_msg_id, two.sender_id) == ("edited", 1, 1)
    assert [(m.kind, m.size_bytes, m.local_rel_path) for m in media.collect()] == [("photo", 5, "photos/p.jpg")]
    assert peers.first().updated_at == 1700000060
    assert readers.read_export_owner(spark, str(tmp_path / "result.json")).first().name == "Me"


PAGE = """<div class="page_header"><div class="text bold"> Club </div></div><div class="history">
<div class="message default clearfix" id="message1"><div class="pull_right date details" title="01.02.2024 10:00:00 UTC+02:00">10:00</div><div class="from_name"> Ann </div><div class="text"> Hi <strong>you</strong> &amp; all </div></div>
<div class="message default clearfix joined" id="message2"><div class="reply_to details"> In reply to <a href="#go_to_message1">this</a></div><div class="text"> again </div></div>
<div class="message service" id="message-1"><div class="body details"> 2 February 2024 </div></div></div>"""


def test_html_export(spark, tmp_path):
    (tmp_path / "club").mkdir()
    (tmp_path / "club/messages.html").write_text(PAGE)
    (tmp_path / "club/messages2.html").write_text('<div class="message default clearfix joined" id="message3"><div class="text"> more </div></div>')
    rows = readers.read_export_html(spark, str(tmp_path), 5).orderBy("message_id").collect()
    assert [(r.message_id, r.sender_name, r.text, r.date, r.reply_to_msg_id) for r in rows] == [(1, "Ann", "Hi you & all", 1706774400, None), (2, "Ann", "again", 1706774400, 1), (3, "Ann", "more", 1706832000, None)]  # the divider's day
    assert json.loads(rows[0].entities_json) == [{"type": "bold", "offset": 3, "length": 3}]
    assert [(r.folder, r.kind, r.n_files) for r in readers.discover_exports(spark, str(tmp_path)).collect()] == [("club", "html", 2)]


def test_export_pages_are_parsed_once(spark):
    """Cutting their elements into ranges takes a sample, which must not parse the pages again."""
    passed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            passed.add(batch.num_rows)
            yield batch

    div = '<div class="message default" id="message{0}"><div class="from_name">A</div><div class="text">a &amp; {0}<br>b</div></div>'
    pages = spark.createDataFrame([(f"c{k % 3}/messages{k or ''}.html", div.format(k + 1)) for k in range(12)], "page string, html string").repartition(4)
    rows = readers.parse_export_pages(pages.mapInArrow(counted, pages.schema), 5).orderBy("message_id").collect()
    assert [(r.folder, r.message_id, r.text, r.sender_name, r.date) for r in rows] == [(f"c{k % 3}", k + 1, f"a & {k + 1}\nb", "A", 5) for k in range(12)]
    assert passed.value == 12


def test_stream_gives_the_batch_result_and_stops_at_unsupported_events(spark, tmp_path):
    base = {"kind": "new", "slice_id": 1, "peer_id": 1, "date": 10, "state": "active", "pts_count": 1, "affects_state": False, "peer": {"peer_id": 1, "peer_type": "user", "name": "Ann"}}
    events = [
        base | {"seq": 1, "message_id": 1, "text": "a", "pts": 1}, base | {"seq": 2, "message_id": 1, "text": "b", "kind": "edit", "state": "edited", "pts": 2}, base | {"seq": 3, "message_id": 2, "text": "c", "pts": 3},
        base | {"seq": 4, "message_id": 2, "kind": "delete", "pts": 4}, base | {"slice_id": 2, "seq": 1, "kind": "unsupported", "affects_state": True, "pts": 5}, base | {"slice_id": 2, "seq": 2, "message_id": 3, "text": "late", "pts": 6},
    ]
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed/0.json").write_text("\n".join(map(json.dumps, events)))
    folder = str(tmp_path / "archive")
    empty = {t: feed.empty_table(spark, t) for t in ("peers", "messages", "sync_state")}
    writers.write_archive(empty, folder, "start")
    stream = readers.read_update_feed(spark, str(tmp_path / "feed"), stream=True)
    feed.stream_apply_updates(stream, folder, str(tmp_path / "check")).awaitTermination()
    got = readers.read_archive(spark, folder, "messages").orderBy("message_id").collect()
    assert [(r.message_id, r.text, r.state) for r in got] == [(1, "b", "edited"), (2, "c", "deleted")]
    state = readers.read_archive(spark, folder, "sync_state").first()
    assert (state.pts, state.uncertain) == (4, True)
    batch = feed.apply_update_slice(empty, spark.read.schema(UPDATES).json(str(tmp_path / "feed")))
    assert sorted(map(tuple, batch["messages"].select("message_id", "text", "state").collect())) == [(1, "b", "edited"), (2, "c", "deleted")]
    assert spark.read.parquet(f"{folder}/log/message_revisions").count() == 1
    # nothing new: a second run changes nothing
    feed.stream_apply_updates(stream, folder, str(tmp_path / "check")).awaitTermination()
    assert readers.read_archive(spark, folder, "messages").count() == 2


def test_a_freeze_outlasts_its_batch_and_loses_nothing(spark, tmp_path):
    base = {"kind": "new", "peer_id": 1, "date": 10, "state": "active", "pts_count": 1, "affects_state": False, "peer": {"peer_id": 1, "peer_type": "user", "name": "Ann"}}
    event = lambda n, **more: base | {"slice_id": n, "seq": 1, "message_id": 9 + n, "text": f"t{n}", "pts": n} | more
    batches = [[event(1), event(2, kind="unsupported", affects_state=True), event(3)], [event(4), event(4, peer_id=2, peer={"peer_id": 2, "peer_type": "user", "name": "Bob"})]]
    folder, seen = str(tmp_path / "archive"), []
    (tmp_path / "feed").mkdir()
    writers.write_archive({t: feed.empty_table(spark, t) for t in ("peers", "messages", "sync_state")}, folder, "start")
    stream = readers.read_update_feed(spark, str(tmp_path / "feed"), stream=True)

    def run(k, events):
        (tmp_path / f"feed/{k}.json").write_text("\n".join(map(json.dumps, events)))
        feed.stream_apply_updates(stream, folder, str(tmp_path / "check")).awaitTermination()
        return sorted((r.peer_id, r.message_id) for r in readers.read_archive(spark, folder, "messages").collect())

    for k, events in enumerate(batches):
        seen.append(run(k, events))
    assert seen == [[(1, 10)], [(1, 10), (2, 13)]]
    assert {r.peer_id: r.uncertain for r in readers.read_archive(spark, folder, "sync_state").collect()} == {1: True, 2: False}
    version = spark.read.text(f"{folder}/CURRENT").first()[0]
    tables = {t: readers.read_archive(spark, folder, t) for t in ("peers", "messages", "sync_state")}
    tables["pending_updates"] = spark.read.parquet(f"{folder}/{version}/pending_updates")
    assert sorted(r.slice_id for r in tables["pending_updates"].collect()) == [2, 3, 4]
    tables |= feed.recover_chats(tables, spark.createDataFrame([(1,)], "peer_id long"))
    writers.write_archive(tables, folder, "recovered")
    assert run(2, [event(5)]) == [(1, 10), (1, 12), (1, 13), (1, 14), (2, 13)]
    assert spark.read.parquet(f"{folder}/log/unsupported_events").count() == 1


def test_search_with_repeated_and_overlapping_terms(spark):
    postings = search.build_postings(messages(spark, *[(1, k, 1, None, t, "active") for k, t in enumerate(["alpha beta", "alpine alpha", "alps", "beta"])]))
    ids = lambda q: sorted(r.message_id for r in search.search(postings, q).collect())
    assert ids("alpha") == ids("alpha alpha") == ids("al* alpha") == [0, 1] and ids("al* alp*") == [0, 1, 2] and ids("alpha al* beta") == [0]


def test_highlight_is_literal(spark):
    shown = lambda text, word: spark.createDataFrame([(text,)], "text string").select(search.highlight("text", word)).first()[0]
    assert shown("a & amp", "amp") == "a &amp; <mark>amp</mark>"
    assert shown("f(a(b)", "a(") == "f(<mark>a(</mark>b)" and shown("x\\Ey", "\\E") == "x<mark>\\E</mark>y"
    assert shown("A<b>a", "a") == "<mark>A</mark>&lt;b&gt;<mark>a</mark>" and shown("abc", "") == "abc" and shown("abc", "z") == "abc"


def test_windowed_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0), (1, 100), (1, 5000), (2, 3)], "peer_id long, t long").select("peer_id", F.timestamp_seconds("t").alias("time"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = feed.activity_windows(stream, "time", "1 hour").writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.peer_id, r.n) for r in spark.table("hours").collect()) == sorted((r.peer_id, r.n) for r in feed.activity_windows(rows, "time", "1 hour").collect())
    assert sorted((r.peer_id, r.n) for r in feed.activity_sessions(rows, "time").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_search_index_round_trip(spark, tmp_path):
    rows = messages(spark, *[(p, k, 1, None, f"word{k} common", "active") for p in (1, 2) for k in range(10)])
    peers = spark.createDataFrame([(1, "user", "Ann", None), (2, "group", None, "club")], "peer_id long, peer_type string, name string, username string")
    entries = windows.entry_shards(search.search_entries(rows, joins.sender_names(rows, peers), joins.authoritative_names(peers)), 6)
    writers.write_search_index(entries, str(tmp_path / "index"))
    back, manifest, prefixes = readers.read_search_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, back.select("peer_id", "message_id", "shard_id").collect())) == sorted(map(tuple, entries.select("peer_id", "message_id", "shard_id").collect()))
    assert audit.audit(audit.Tables(manifest=manifest, shards=back.select("shard_id"), prefixes=prefixes), ("search_index",)).count() == 0
    wanted = {r.shard_id for r in search.candidate_shards(prefixes, manifest, "word3").collect()}
    brute = {r.shard_id for r in search.score_entries(back, "word3").collect()}
    assert brute <= wanted


def test_statuses_and_order_of_findings(spark):
    rows = [("UNKNOWN_PEER_TYPE", "identity", "warning", 2, None, None, None), ("REQUIRED_TABLE_MISSING", "schema", "fatal", None, None, "t", None), ("PEER_ID_ZERO", "identity", "error", 0, None, None, None), ("MESSAGE_ID_INVALID_RANGE", "identity", "error", None, None, None, None)]
    found = spark.createDataFrame(rows, "code string, category string, severity string, peer_id long, message_id long, subject string, detail string")
    assert [r.code for r in audit.sort_findings(found).collect()] == ["REQUIRED_TABLE_MISSING", "MESSAGE_ID_INVALID_RANGE", "PEER_ID_ZERO", "UNKNOWN_PEER_TYPE"]
    status = lambda df, strict=False: tuple(audit.overall_status(df, strict).first())
    assert status(found) == ("fatal", 3) and status(found.where("severity <> 'fatal'"), True) == ("errors", 2)
    warned = found.where("severity = 'warning'")
    assert status(warned) == ("warnings", 1) and status(warned, True) == ("warnings", 2) and status(found.limit(0), True) == ("passed", 0)


def test_files_in_use_are_no_orphans(spark):
    files = spark.createDataFrame([("media/a.bin.part", 5, "x", True), ("b.bin.part", 5, "x", True), ("c.bin", 5, None, False), ("d.bin", 5, "y", False), ("e.bin", 5, "y", False)], "rel_path string, length long, sha256 string, is_part boolean")
    media = spark.createDataFrame(
        [("a", "media/a.bin", "downloading", "unverified", 9, "x"), ("c", "c.bin", "completed", "verified", 0, "x"), ("d", "media/d.bin", "completed", "unverified", 5, "x"), ("e", "e.bin", "completed", "verified", 5, "x"), ("f", "f.bin", "completed", "verified", 5, "x")],
        "media_id string, local_rel_path string, download_status string, verification_status string, size_bytes long, sha256 string")
    found = {r.path: r.result for r in joins.match_files(files, media).collect()}
    assert found == {"a.bin.part": "in_use", "b.bin.part": "orphan_part", "c.bin": "unreadable", "d.bin": "unverified", "e.bin": "hash_mismatch", "f.bin": "missing"}


def test_broken_bundles_are_findings(spark):
    pages = spark.createDataFrame([("a.html", '<i id="t"></i><i id="t"></i><a href="no.html">1</a>'), ("b.html", "")], "page string, html string")
    anchors = links.extract_anchors(pages)
    counts = links.bundle_counts(spark.createDataFrame([(1, 0)], "peer_id long, page_no int"), spark.createDataFrame([(1, 2)], "peer_id long, n_pages long"))
    found = audit.bundle_findings(links.duplicate_anchors(anchors), links.broken_links(links.extract_links(pages), pages, anchors), counts).collect()
    assert {r.code for r in found} == {"HTML_INTEGRITY_VIOLATION"} and sorted(r.detail for r in found) == ["anchor t", "link no.html", "pages 1"]


def test_walks_of_any_length(spark):
    """A chain longer than the limit, a cycle with a tail, and a message alone, each doubled until it ends."""
    chain = [(1, k, 1, None, "x", "active", *([k - 1] if k > 1 else [])) for k in range(1, 60)]
    cycle = [(2, k, 1, None, "x", "active", k % 5 + 1) for k in range(1, 6)] + [(2, 9, 1, None, "x", "active", 3), (2, 10, 1, None, "x", "active")]
    rows = messages(spark, *chain, *cycle)
    found = graph.walks(rows, 4)
    depth = {(r.peer_id, r.message_id): r.depth for r in graph.reply_depth(found).collect()}
    assert depth == {(1, k): k - 1 for k in range(1, 60)} | {(2, k): None for k in (1, 2, 3, 4, 5, 9)} | {(2, 10): 0}
    assert [(r.message_id, r.n_members, r.tail_count) for r in graph.reply_cycles(found, rows).collect()] == [(1, 5, 1)]


def test_sizes_without_area_are_told_apart(spark):
    """Which of them is taken doesn't depend on the order of rows."""
    sizes = [(1, 3, 0, 54, 2), (1, 3, 0, 51, 2), (1, 3, 0, 7, 2)]
    for rows in (sizes, sizes[::-1]):
        found = lookups.best_photo_size(spark.createDataFrame(rows, "photo_id long, ordinal int, width long, height long, bytes long").coalesce(1), ["photo_id"])
        assert [tuple(r) for r in found.collect()] == [sizes[0]]


def test_folding_holds_few_texts_at_a_time():
    """A batch's texts are several times their bytes as Python strings, so only some are there at once."""
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([None, "ÀB", "a\U0001d165b", "ﬁ"] + ["Ā" + "é" * 10_000] * 2000)
    tracemalloc.start()
    found = search.fold_texts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[:4].to_pylist() == [None, "ab", "ab", "fi"] and found[-1].as_py() == "a" + "e" * 10_000 and len(found) == 2004
    assert peak < 8 << 20
    assert search.fold_texts(pa.array([], pa.string())).to_pylist() == []


def test_many_small_files_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A table of pages in one row group is read by one task, which must not write all of their files."""
    from parley.plans import registry, storage

    monkeypatch.setattr(storage, "scratch", lambda _: f"{tmp_path}/files")
    monkeypatch.setattr(storage, "TASK_FILES", 8)
    found = registry.QUERIES["s5_scan_media_files"](spark, "/root/testdata/sf0.001").count()
    tasks = {f.name.split("-")[1] for f in (tmp_path / "files").rglob("part-*.txt")}
    assert found == sum(1 for _ in (tmp_path / "files").rglob("part-*.txt")) > 8 and len(tasks) > 1


def test_snippets_of_texts_without_any_line(spark, tmp_path):
    """A document of nothing but blanks and line ends has no first line to be taken."""
    import duckdb

    from parley.plans import registry

    rows = [(1, ""), (2, " "), (3, "\n \n\n"), (4, None), (5, "\n  a \nb"), (6, "\t"), (7, "é" * 100), (8, "é" * 101), (9, "\r\nb")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = sorted(map(tuple, registry.QUERIES["x19_reply_snippet"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert found == sorted(con.execute(registry.ORACLE_SQL["x19_reply_snippet"]).fetchall())
    assert [s for _, s in found[:5]] == ["Attachment"] * 4 + ["  a "]


def test_small_files_share_folders_and_keep_their_rows(spark, tmp_path, monkeypatch):
    """A folder for each file cost more than the file; pages of one id, of negative ids and of none are files of their own."""
    import hashlib

    from parley.plans import registry, storage

    rows = [(1, "a"), (1, "é"), (-5, "b\nc"), (None, ""), (7, None), *((n, f"page {n}") for n in range(100, 160))]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/in/pages.parquet")
    monkeypatch.setattr(storage, "scratch", lambda _: f"file:{tmp_path}/files")
    monkeypatch.setattr(storage, "TASK_FILES", 16)
    found = registry.QUERIES["s5_scan_media_files"](spark, f"{tmp_path}/in").collect()
    want = [(k, len((h + "\n").encode()), hashlib.sha256((h + "\n").encode()).hexdigest(), False) for k, h in rows if h is not None]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert 1 < sum(1 for p in (tmp_path / "files").rglob("*") if p.is_dir()) <= 8
    # what an attempt that failed has left isn't counted
    (tmp_path / "files/left").mkdir()
    (tmp_path / "files/left/part-00000-0000000-page_id=1.txt").write_text("a")
    assert len(readers.scan_media_files(spark, f"{tmp_path}/files", [str(p) for p in (tmp_path / "files").iterdir() if p.name != "left"]).collect()) == len(want)
