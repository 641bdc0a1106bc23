"""Queries over the finer rules of the formats, each with the relational
statement of its rows; they are listed with those of ``queries``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cueframe.functions import ass_text, srt_text, times, trees, vtt_text
from cueframe.functions.lines import BOM
from cueframe.operators.ass import parse_ass, parse_event_line, split_fields, write_ass
from cueframe.operators import srt_batches, vtt_batches
from cueframe.operators.srt import parse_srt, write_srt
from cueframe.operators.vtt import parse_vtt, write_vtt
from cueframe.plans.options import AssOptions, EventFormat, SrtOptions
from cueframe.queries import _documents, _events, _numbered, _spread, _srt_time, _table, _timing, _vtt_time, query
from cueframe.sources.large import read_large_srt, scratch, write_srt_files
from cueframe.streaming.ordered import order_packets
from cueframe.streaming.packets import clean_packets, event_packets


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _chosen(key: Column, texts: list[str | None]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]), (key % len(texts) + 1).cast("int"))


@query("""
select n_nationkey doc_id, n_name || '|' || n_name || '2' srt_bodies, case n_nationkey % 3 when 1 then 'InvalidSignature' when 2 then 'MissingSignature' end vtt_error,
case when n_nationkey % 3 = 0 then n_name end vtt_body, n_name || ' ' as ass_text from nation""")
def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte order marks at the start of documents and lines, and signatures."""
    nations = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("name"))
    name = F.col("name")
    srt = nations.select("doc_id", _text(BOM, "1\n00:00:01,000 --> 00:00:02,000\n", name, "\n", BOM, "\n", BOM, "2\n", BOM, "00:00:03,000 --> 00:00:04,000\n", name, "2").alias("content"))
    srt = parse_srt(srt).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "body"))), lambda x: x["body"]), "|").alias("srt_bodies"))
    vtt = nations.select("doc_id", _text(BOM, _chosen(F.col("doc_id"), ["WEBVTT", "WEBVTTX", "WEB VTT"]), "\n\n00:01.000 --> 00:02.000\n", name, "\n").alias("content"))
    vtt = parse_vtt(vtt).select("doc_id", F.col("error").alias("vtt_error"), F.col("body").alias("vtt_body"))
    ass = nations.select("doc_id", _text(BOM, "  \n\t[Events]\n \t Format: Text\n\n  Dialogue: ", name, " \n").alias("content"))
    ass = parse_ass(ass).where("block_type = 'event'").select("doc_id", F.col("event.text").alias("ass_text"))
    return srt.join(vtt, "doc_id").join(ass, "doc_id")


@query("""
select o_orderkey, case when o_orderkey % 3 <> 0 then o_orderkey end read_order, case when o_orderkey % 3 <> 0 then o_orderkey % 9 - 4 end layer, case when o_orderkey % 3 <> 0 then o_orderpriority || ', yes' end as plain,
case when o_orderkey % 3 = 0 then 'TooFewFields(9,2)' end as error from orders""")
def packet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of container packets, which carry a read order and no times."""
    key = F.col("o_orderkey")
    row = F.when(key % 3 == 0, _text(key, ",", key % 9)).otherwise(_text(key, ", ", key % 9 - 4, " ,Default,A,0,0,0,,{\\i1}", F.col("o_orderpriority"), ", yes"))
    found = event_packets(_spread(_table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", row.alias("row")))
    fine = F.col("error").isNull()
    found = found.select("o_orderkey", F.when(fine, F.col("event.read_order")).alias("read_order"), F.when(fine, F.col("event.layer")).alias("layer"), F.when(fine, F.col("event.text")).alias("body"), "error")
    return clean_packets(found, "ass").drop("body")


@query("""
with t as (select cast(user_id % 50 as varchar) track, ts, event_id * 7919 % 10007 read_order, event_type || ',' || event_id as row from events),
o as (select *, row_number() over w - 1 as ordinal, max(read_order) over (w rows between unbounded preceding and 1 preceding) as before from t window w as (partition by track order by ts, read_order, row))
select track, ordinal, read_order, row as shown, before is null or read_order > before as rising from o""")
def packet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of tracks in the order of their time, and whether their read orders rise."""
    key = F.col("event_id")
    rows = _table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("track"), "ts", (key * 7919 % 10007).alias("read_order"), _text(F.col("event_type"), ",", key).alias("row"))
    return order_packets(rows).select("track", "ordinal", "read_order", F.col("row").alias("shown"), "rising")


@query("""
with t as (select p_partkey, p_partkey % 1300 h, p_size * 2 s, p_partkey % 1100 ms, p_partkey * 4611686018427388 as big from part)
select p_partkey, case when h >= 10 and h < 1000 then h end hour_value, case when h < 10 then 'NotPadded' when h >= 1000 then 'Overflow(' || h || ')' end hour_error,
case when s >= 10 and s < 60 then s end second_value, case when s < 10 then 'NotPadded' when s >= 60 then 'Overflow(' || s || ')' end second_error,
case when ms >= 100 and ms < 1000 then ms end milli_value, case when ms < 100 then 'NotPadded' when ms >= 1000 then 'Overflow(' || ms || ')' end milli_error,
'ParseInt' as word_error, cast(p_partkey % 100 as bigint) as centi_value, case when p_partkey < 10 then '0' || p_partkey else '' || p_partkey end as hour_shown,
case when cast(big as hugeint) * 5 <= 18446744073709551615 then cast(cast(big as hugeint) * 5 as varchar) else 'ParseInt' end as long_hour from t""")
def unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours, seconds, milliseconds and centiseconds by themselves."""
    key = F.col("p_partkey")
    big = key.cast("decimal(20,0)") * F.lit(4611686018427388 * 5).cast("decimal(17,0)")
    rows = _spread(_table(spark, sf_dir, "part"), "p_partkey").select(
        "p_partkey", times.unit((key % 1300).cast("string"), "hour").alias("h"), times.unit((F.col("p_size") * 2).cast("string"), "second").alias("s"), times.unit((key % 1100).cast("string"), "millisecond").alias("m"),
        times.unit(_text("x", key), "minute").alias("w"), times.unit(F.lpad((key % 100).cast("string"), 2, "0"), "centisecond").alias("c"), times.show_hour(key).alias("hour_shown"), times.long_hour(big.cast("string")).alias("l"),
    )
    return rows.select(
        "p_partkey", F.col("h.value").alias("hour_value"), F.col("h.error").alias("hour_error"), F.col("s.value").alias("second_value"), F.col("s.error").alias("second_error"), F.col("m.value").alias("milli_value"),
        F.col("m.error").alias("milli_error"), F.col("w.error").alias("word_error"), F.col("c.value").alias("centi_value"), "hour_shown", F.coalesce(F.col("l.value").cast("string"), "l.error").alias("long_hour"),
    )


@query("""
with t as (select o_orderkey, (o_orderkey * 86399999) % 7200000000 ms from orders)
select o_orderkey, case when ms < 3600000000 then printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) end srt, case when ms >= 3600000000 then 'Overflow' end srt_error,
case when ms < 3600000 then '' else printf('%02d:', ms // 3600000) end || printf('%02d:%02d.%03d', ms // 60000 % 60, ms // 1000 % 60, ms % 1000) vtt, ms // 3600000 as hours, ms // 1000 as seconds,
(ms // 3600000) || '/' || (ms % 1000) || '/' || (ms // 60000 % 60) || '/' || (ms // 1000 % 60) as field_order from t""")
def duration_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations to stamps and intervals; SubRip holds 999 hours at most."""
    ms = (F.col("o_orderkey") * 86399999) % 7200000000
    srt, vtt = times.from_total(ms, most_hours=999), times.from_total(ms)
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", srt.alias("a"), vtt.alias("b"))
    b = F.col("b")
    return rows.select(
        "o_orderkey", times.encode_srt(F.col("a")).alias("srt"), F.when(F.col("a").isNull(), "Overflow").alias("srt_error"), times.encode_vtt(b).alias("vtt"), b["h"].cast("long").alias("hours"),
        F.floor(F.unix_seconds(F.timestamp_seconds(F.lit(0)) + times.interval(b))).alias("seconds"), F.concat_ws("/", *[x.cast("string") for x in times.field_order(b)]).alias("field_order"),
    )


@query("""
select c_custkey, 'color="' || c_mktsegment || '" Size=' || (c_custkey % 7) || ' bold x="a b"' as attributes, 'color|Size|bold|x' as names, c_mktsegment || '|' || (c_custkey % 7) || '|-|a b' as vals, 'true|true|false|false' as known,
'<font color="' || c_mktsegment || '" Size=' || (c_custkey % 7) || ' bold x="a b">' as tag, 'color=' || c_mktsegment || ' Size=' || (c_custkey % 7) || ' bold x="a b"' as shown, '{\\an' || (c_custkey % 9 + 1) || '}' as code, '</font>' as end_tag
from customer""")
def srt_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of start tags, known ones among them, and how tags, attributes and codes are shown."""
    key = F.col("c_custkey")
    body = _text('<FONT \tcolor="', F.col("c_mktsegment"), '" Size=', key % 7, ' bold x="a b" >', F.col("c_name"), "</font\t>{\\an", key % 9 + 1, "}")
    rows = _spread(_table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", srt_text.tokens(body).alias("ts"))
    rows = rows.select("c_custkey", "ts", srt_text.attributes(F.col("ts")[0]["attributes"]).alias("attrs"))
    ts, attrs = F.col("ts"), F.col("attrs")
    return rows.select(
        "c_custkey", ts[0]["attributes"].alias("attributes"), F.array_join(F.transform(attrs, lambda a: a["name"]), "|").alias("names"), F.array_join(F.transform(attrs, lambda a: a["value"]), "|", "-").alias("vals"),
        F.array_join(F.transform(attrs, lambda a: srt_text.is_known(a["name"]).cast("string")), "|").alias("known"), srt_text.show_start_tag(ts[0]["tag"], ts[0]["attributes"]).alias("tag"),
        F.array_join(F.transform(attrs, lambda a: srt_text.show_attribute(a["name"], a["value"])), " ").alias("shown"), srt_text.show_code(ts[3]["text"]).alias("code"), _text("</", ts[2]["tag"], ">").alias("end_tag"),
    )


@query("""
select c_custkey doc_id, 1 as cues, 'Timestamp|Text|Text|Timestamp|Text|StartTag' as kinds, 'x|y|' || c_name as texts, '00:00:01.500|18446744073709551615:00:02.000' as stamps from customer""")
def vtt_bad_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing lines out of range are passed over with their text; timestamp tags out of range and tags without an end in cue text."""
    body = _text("<00:01.500>x<00:99.000>y<18446744073709551615:00:02.000>", F.col("c_name"), "<18446744073709551616:00:02.000><b")
    content = _text("WEBVTT\n\n00:61.000 --> 00:62.000\nlost\n\n00:0a.000 --> 00:01.000\nlost\n\n18446744073709551616:00:00.000 --> 00:01.000\nlost\n\n00:01.000 -> 00:02.000\nlost\n\n00:01.000 --> 00:02.000\n", body, "\n")
    cues = vtt_batches.parse_vtt(_spread(_table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.col("c_name"), content.alias("content"))).where("block_type = 'cue'")
    rows = cues.select("doc_id", vtt_text.tokens(F.col("body")).alias("ts"))
    shown = lambda t: F.when(t["ts"]["h"] == 0, F.concat(F.lit("00:"), times.encode_vtt(t["ts"]))).otherwise(times.encode_vtt(t["ts"]))
    rows = rows.select(
        "doc_id", F.array_join(F.transform("ts", lambda t: t["kind"]), "|").alias("kinds"), F.array_join(F.transform(F.filter("ts", lambda t: t["kind"] == "Text"), lambda t: t["text"]), "|").alias("texts"),
        F.array_join(F.transform(F.filter("ts", lambda t: t["kind"] == "Timestamp"), shown), "|").alias("stamps"),
    )
    return rows.groupBy("doc_id").agg(F.count("*").alias("cues"), F.max("kinds").alias("kinds"), F.max("texts").alias("texts"), F.max("stamps").alias("stamps"))


@query("""
select n_nationkey doc_id, case when n_nationkey % 5 = 0 then 'WEBVTT made here' || chr(10) else 'WEBVTT made here' || chr(10) || chr(10) || 'NOTE' || chr(10) || 'on ' || n_name || chr(10) || chr(10) || 'STYLE' || chr(10) || '::cue {}' || chr(10)
|| chr(10) || 'REGION' || chr(10) || 'id:r' || n_nationkey || chr(10) || 'width:' || ['0.0001', '12.5', '33', '99.999', '0'][n_nationkey % 5 + 1] || '%' || chr(10) || 'lines:' || (n_nationkey + 4) || chr(10) || 'regionanchor:0.00025%,1%' || chr(10)
|| 'viewportanchor:10%,90%' || chr(10) || 'scroll:up' || chr(10) || chr(10) || 'id ' || n_nationkey || chr(10)
|| '00:01.000 --> 00:02.000 vertical:rl line:5%,start position:0.5%,center size:0.0001% align:end region:r' || n_nationkey || chr(10) || '<v A&amp;B>' || n_name || ' & more</v>' || chr(10) end as content from nation""")
def vtt_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes, styles, regions, settings and node bodies written; documents without blocks are their signature."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    content = _text(
        "WEBVTT\n\nNOTE on ", name, "\n\nSTYLE\n::cue {}\n\nREGION\nid:r", key, "\nwidth:", _chosen(key, ["0.0001", "12.50", "33.0", "99.999", "0"]), "%\nlines:", key + 4,
        "\nregionanchor:0.00025%,1%\nviewportanchor:10%,90%\nscroll:up\n\nid ", key, "\n00:01.000 --> 00:02.000 vertical:rl line:5%,start position:0.5%,center size:0.0001% align:end region:r", key,
        "\n<v A&amp;B>", name, " &amp; more\n",
    )
    docs = _table(spark, sf_dir, "nation").select(key.alias("doc_id"), F.when(key % 5 == 0, "WEBVTT\n").otherwise(content).alias("content"))
    blocks = parse_vtt(docs)
    blocks = blocks.withColumn("nodes", F.when(F.col("block_type") == "cue", vtt_text.tree(F.col("body"))["nodes"]))
    return write_vtt(blocks, header="made here", docs=docs)


@query("""
select conv_id, turn, '| <ruby>' || chr(10) || '|   "' || role || '"' || chr(10) || '|   <rt>' || chr(10) || '|     "' || turn || '"' || chr(10) || '| "plain"' || chr(10) || '| <b>' || chr(10) || '|   <i>' || chr(10) || '|     "x"' || chr(10) || '|   "y"' as dumped,
'<ruby>' || role || '<rt>' || turn || '</rt></ruby>plain<b><i>x</i>y</b>' as written, 'MaxDepthExceeded(1)' as depth_error, '<ruby>' || role || '<rt>' || turn || '</rt></ruby>plain<u.loud><i>x</i>y</u>' as edited,
role || '<rt>' || turn || '</rt>plain<b><i>x</i>y</b>' as unwrapped, 3 as top_nodes from conversations""")
def vtt_tree_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of ruby and of end tags, the depth error, dumps, and edits of trees."""
    body = _text("<ruby>", F.col("role"), "<rt>", F.col("turn"), "</ruby><rt>plain</rt><b><i>x</b></i>y")
    rows = _spread(_table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn", vtt_text.tree(body)["nodes"].alias("n"), vtt_text.try_tree(body, 1)["error"].alias("depth_error"))
    n = F.col("n")
    changed = vtt_text.edit(n, lambda x: x["tag"] == "b", tag=lambda x: F.lit("u"), classes=lambda x: F.lit("loud"))
    return rows.select(
        "conv_id", "turn", vtt_text.dump(n).alias("dumped"), vtt_text.serialize(n).alias("written"), "depth_error", vtt_text.serialize(changed).alias("edited"),
        vtt_text.serialize(vtt_text.unwrapped(n, F.lit(0))).alias("unwrapped"), F.size(vtt_text.children_of(n)).alias("top_nodes"),
    )


@query("""
with t as (select c_custkey, c_custkey % 3 k, c_nationkey p, '<i>x</i>' i, '<lang en><u>y</u></lang>' l, '<b>' || c_name || '<i>x</i></b>' b, c_name n, c_mktsegment s, '<c.n>+</c>' c from customer)
select c_custkey, '<b>' || case k when 0 then c || n || i when 1 then n || c || i else n || i || c end || '</b>' || s || l as inserted, '<b>' || case k when 0 then l || n || i when 1 then n || l || i else n || i || l end || '</b>' || s as moved,
case when k = 0 then s || l else b || l end as removed, '<b>' || p || '<u>z</u></b>' || s || l as with_children, n || i as into, b || '<v.m ' || p || '>' || s || '</v>' || l as wrapped,
'- en en en en en en en' as languages, s || '<lang en><u>y</u>' || b || '</lang>' as below, '4 2 4 4 5 8 8 8' as intervals, true as stable from t""")
def vtt_tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children inserted, moved, removed, replaced and wrapped, from literals and from the tree itself."""
    key, note = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    body = _text("<b>", F.col("c_name"), "<i>x</i></b>", F.col("c_mktsegment"), "<lang en><u>y</u></lang>")
    rows = _spread(_table(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", "c_nationkey", vtt_text.tree(body)["nodes"].alias("n"))
    n, k, leave = F.col("n"), (key % 3).cast("int"), F.when(key % 3 == 0, 0).otherwise(4)
    edits = rows.select(
        "c_custkey",
        trees.inserted(n, 0, k, trees.forest(trees.tag("c", trees.text("+"), classes="n"))).alias("inserted"),
        trees.moved(n, 5, 0, k).alias("moved"),
        trees.removed(n, leave).alias("removed"),
        trees.with_children(n, 0, trees.forest(trees.text(note), trees.tag("u", trees.text("z")))).alias("with_children"),
        trees.children(n, 0).alias("into"),
        trees.wrapped(n, 4, "v", classes="m", annotation=note).alias("wrapped"),
        trees.moved(n, 0, 5, 1).alias("below"),
        F.array_join(trees.ends(n).cast("array<string>"), " ").alias("intervals"),
    )
    edits = edits.withColumn("languages", F.array_join(F.transform("below", lambda x: F.coalesce(x["lang"], F.lit("-"))), " "))
    shown = [vtt_text.serialize(F.col(c)).alias(c) for c in ("inserted", "moved", "removed", "with_children", "into", "wrapped", "below")]
    return edits.select("c_custkey", *shown, "languages", "intervals", (vtt_text.tree(vtt_text.serialize(F.col("moved")))["nodes"] == F.col("moved")).alias("stable"))


@query("""
select cast(event_id % 5 as varchar) doc_id, row_number() over (partition by event_id % 5 order by event_id) - 1 as ordinal, event_id + 1 as index_shown,
event_id * 10 as start_ms, event_id * 10 + 900 as end_ms, event_type || chr(10) || user_id as body, cast(null as varchar) as error from events""")
def large_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few large documents, written in ranges of their entries and read in parts."""
    key = F.col("event_id")
    entries = _table(spark, sf_dir, "events").select(
        (key % 5).cast("string").alias("doc_id"), key.alias("ordinal"), (key + 1).alias("index"), times.from_total(key * 10).alias("start"), times.from_total(key * 10 + 900).alias("end"),
        _text(F.col("event_type"), "\n", F.col("user_id")).alias("body"),
    )
    path = f"{scratch(spark)}/large-{uuid.uuid4().hex}"
    write_srt_files(entries, path)
    rows = read_large_srt(spark, path, part_bytes=1 << 16, staging=f"{path}-parts")
    return rows.select("doc_id", "ordinal", F.col("index").cast("long").alias("index_shown"), "start_ms", "end_ms", "body", "error")


@query("""
select c_custkey doc_id, u.nth, u.layer, u.start_cs, u.name, u.t || case when u.nth <> 1 then c_name else '' end as text from customer, lateral (values
(0, null, 100, null, ''), (1, 3, null, null, ''), (2, 4, 200, 'N', 'two, '), (3, null, 300, 'M', 'three ')) u(nth, layer, start_cs, name, t)""")
def ass_lossy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tolerant reading: bad numbers are null, short rows padded, other lines
    passed over, and a section entered anew has its default columns."""
    name = F.col("c_name")
    content = _text(
        "[Events]\nFormat: Layer, Start, Text\nDialogue: x,0:00:01.00,", name, "\nnonsense\nDialogue: 3\n[Events]\nDialogue: 4,0:00:02.00,0:00:03.00,D,N,0,0,0,,two, ", name,
        "\n[Open\nComment: -99999999999,0:00:03.00,bad,D,M,0,x,0,,three ", name, "\n",
    )
    options = AssOptions.from_json(AssOptions.lossy().to_json())
    found = parse_ass(_spread(_table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), content.alias("content")), options).where("event is not null")
    e = F.col("event")
    nth = F.when(F.col("ordinal") > 4, F.col("ordinal") - 3).otherwise(F.col("ordinal") - 2)
    return found.select("doc_id", nth.alias("nth"), e["layer"].alias("layer"), times.total(e["start"], 100).cast("long").alias("start_cs"), e["name"].alias("name"), e["text"].alias("text"))


@query("""
select c_custkey doc_id, u.ordinal, u.block_type, u.section, replace(u.t, '@', c_name) as text, u.key, replace(u.val, '@', c_name) as value, replace(u.fields, '@', c_name) as fields from customer, lateral (values
(0, 'section', 'Script Info', null, null, null, null), (1, 'comment', 'Script Info', ' hello @', null, null, null), (2, 'property', 'Script Info', null, 'Title', '@: x ', null),
(3, 'section', 'V4+ Styles', null, null, null, null), (4, 'format', 'V4+ Styles', 'Name, Fontname', null, null, 'Name|Fontname'), (5, 'style', 'V4+ Styles', '@ , Arial', null, null, '@|Arial'),
(6, 'section', 'Fonts', null, null, null, null), (7, 'property', 'Fonts', null, 'fontname', 'a', null), (8, 'data', 'Fonts', ';M`:x', null, null, null), (9, 'section', 'My STYLES', null, null, null, null),
(10, 'style', 'My STYLES', 'a,b', null, null, 'a|b'), (11, 'section', 'Other', null, null, null, null), (12, 'property', 'Other', null, 'Style', 'c', null), (13, 'property', 'Other', null, 'Dialogue', 'd', null)
) u(ordinal, block_type, section, t, key, val, fields)""")
def ass_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, comments, properties, columns, styles and embedded files."""
    name = F.col("c_name")
    content = _text(
        "[script info]\n; hello ", name, "\nTitle :  ", name, ": x \n\n[V4+ styles]\nFormat: Name, Fontname\nstyle: ", name, " , Arial\n[Fonts]\nfontname: a\n;M`:x\n[My STYLES]\nStyle: a,b\n[Other]\nStyle: c\nDialogue: d\n"
    )
    found = parse_ass(_spread(_table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), content.alias("content")))
    fields = F.when(F.col("block_type").isin("format", "style"), F.array_join(split_fields(F.col("text")), "|"))
    return found.select("doc_id", "ordinal", "block_type", "section", "text", "key", "value", fields.alias("fields"))


@query("""
select o_orderkey, case when o_orderkey % 3 <> 2 then case o_orderkey % 3 when 0 then 'Dialogue' else 'Comment' end end as kind, case when o_orderkey % 3 <> 2 then 'Marked=0' end as marked,
case when o_orderkey % 3 <> 2 then o_orderpriority || ',x ' end as text, case when o_orderkey % 3 = 2 then 'UnexpectedLine' end as error, 9 as text_at, 'Marked' as first_field, 10 as columns,
case when o_orderkey % 3 <> 2 then case o_orderkey % 3 when 0 then 'Dialogue: ' else 'Comment: ' end || 'Marked=0,0:00:01.00,0:00:02.00,,,0,0,0,,' || o_orderpriority || ',x ' end as written from orders""")
def ass_event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines with their keyword, under a stored form of the older columns."""
    from cueframe.operators.ass import encode_event

    columns = EventFormat.from_json(EventFormat.ssa().to_json())
    key = F.col("o_orderkey")
    line = _text(_chosen(key, ["  dialogue: ", "Comment :", "Speech: "]), "Marked=0,0:00:01.00,0:00:02.00,,,0,0,0,,", F.col("o_orderpriority"), ",x ")
    event, error = parse_event_line(line, columns.column())
    rows = _spread(_table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", event.alias("e"), error.alias("error"))
    e = F.col("e")
    return rows.select(
        "o_orderkey", e["kind"].alias("kind"), e["marked"].alias("marked"), e["text"].alias("text"), "error", F.lit(columns.index_of("Text")).alias("text_at"), F.lit(columns.field_at(0)).alias("first_field"),
        F.lit(len(columns)).alias("columns"), F.when(e.isNotNull(), encode_event(e, columns.column())).alias("written"),
    )


@query("""
select c_custkey doc_id, '[Events]' || chr(10) || 'Dialogue: Marked=1,0:00:01.00,0:00:02.00,,' || c_name || ',0,0,0,,x' || chr(10) || chr(10) || '[Events]' || chr(10) || 'Format: Text' || chr(10) || 'Dialogue: y' || chr(10) as content from customer""")
def ass_default_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that a section without a Format line is written under, and those of a later one."""
    content = _text("[Events]\nFormat: Marked, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\nDialogue: Marked=1,0:00:01.00,0:00:02.00,,", F.col("c_name"), ",0,0,0,,x\n[Events]\nFormat: Text\nDialogue: y\n")
    blocks = parse_ass(_spread(_table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("doc_id"), content.alias("content")))
    return write_ass(blocks.where("ordinal <> 1"), EventFormat.ssa())


@query("""
select p_partkey, 'b|t|iclip|p|foo|1c' as names, '1|(0,\\fs2\\b0)|(' || p_size || ',2)|' || (p_size % 3) || '|bar|&H' || p_size || '&' as args, 'true|true|true|true|false|true' as known,
'\\b1\\t(0,\\fs2\\b0)\\iclip(' || p_size || ',2)\\p' || (p_size % 3) || '\\foobar\\1c&H' || p_size || '&' as shown, '{note\\b1}' as block, case when p_size % 3 = 0 then p_name || ' ' || p_name else ' ' end as plain from part""")
def ass_override_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of an override block, their arguments, how they are shown, and the drawings that they start."""
    size = F.col("p_size")
    inside = _text("note\\b1\\t(0,\\fs2\\b0)\\ iclip(", size, ",2)\\p", size % 3, "\\foobar\\1c&H", size, "&")
    tags = ass_text.override_tags(inside)
    rows = _spread(_table(spark, sf_dir, "part"), "p_partkey").select("p_partkey", "p_name", tags.alias("ts"), inside.alias("inside"))
    ts = F.col("ts")
    name = lambda t: F.when(t["known"], t["name"]).otherwise("foo")
    args = lambda t: F.when(t["known"], t["args"]).otherwise(F.concat(F.substring(t["name"], 4, 99), t["args"]))
    text = _text("{", F.col("inside"), "}", F.col("p_name"), "{\\p0} {\\p}", F.when(F.col("inside").rlike(r"\\p0"), F.col("p_name")).otherwise(""))
    return rows.select(
        "p_partkey", F.array_join(F.transform(ts, name), "|").alias("names"), F.array_join(F.transform(ts, args), "|").alias("args"), F.array_join(F.transform(ts, lambda t: t["known"].cast("string")), "|").alias("known"),
        F.array_join(F.transform(ts, lambda t: ass_text.show_tag(t["name"], t["args"])), "").alias("shown"), ass_text.show_block(F.lit("note\\b1")).alias("block"), ass_text.plain_text(text).alias("plain"),
    )


@query("""
select c_custkey doc_id, case when c_custkey % 4 = 0 then '' else '1' || chr(10) || '00:00:01,000 --> 00:00:02,000' || chr(10) || c_name || chr(10) end as content from customer""")
def srt_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options in their stored form; documents without entries are written empty."""
    key = F.col("c_custkey")
    content = F.when(key % 4 == 0, "no entry here\n").otherwise(_text("stray\n1\n00:00:01,000 --> 00:00:02,000\n", F.col("c_name"), "\n\n9\nno header\n"))
    docs = _spread(_table(spark, sf_dir, "customer"), "c_custkey").select(key.alias("doc_id"), content.alias("content"))
    options = SrtOptions.from_json('{"ignore_orphan_text": true, "ignore_broken_header": true}')
    return write_srt(srt_batches.parse_srt(docs, options).where("error is null"), docs)


@query("""
with e as (select *, row_number() over (partition by user_id order by event_id) rn, count(*) over (partition by user_id) n from events)
select user_id doc_id, rn - 1 as ordinal, case when rn % 40 > 0 then rn end idx, case when rn % 40 > 0 then rn * 2000 end start_ms, case when rn % 40 > 0 then event_type || chr(10) || event_id end body,
case when rn % 40 = 0 then 'NonMonotonicIndex' end error, case when rn % 40 = 0 then (rn - 1) || ' ' || (rn - 1) end detail from e where rn <= 40""")
def srt_batch_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries read by batches; the fortieth of a user repeats an index, which ends a document."""
    rn = F.col("rn")
    index = F.when(rn % 40 == 0, rn - 1).otherwise(rn)
    text = _text(index, "\r\n", _timing(rn, _srt_time), F.col("event_type"), "\n", F.col("event_id"), "\r\n\n")
    found = srt_batches.parse_srt(_documents(_events(spark, sf_dir), "user_id", "rn", text))
    detail = F.concat_ws(" ", F.col("error_detail")["last"], F.col("error_detail")["got"])
    return found.select(
        "doc_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("index").cast("long").alias("idx"), "start_ms", "body", "error", F.when(F.col("error").isNotNull(), detail).alias("detail")
    )


@query("""
with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) rn from orders)
select o_custkey doc_id, 2 * (rn - 1) + b as ordinal, case when b = 1 then 'cue' when rn = 1 then 'region' else 'note' end block_type, case when b = 1 then 'order ' || o_orderkey end identifier,
case when b = 1 then rn * 2000 end start_ms, case when b = 1 then rn * 2000 + 1500 end end_ms, case when b = 1 and rn % 2 = 1 then rn % 40 + 0.25::double end pos_pct, case when b = 1 and rn % 2 = 1 then 'line-right' end pos_align,
case when b = 1 and rn % 2 = 0 then -rn end line_num, case when b = 1 then o_orderpriority when rn > 1 then o_orderstatus || chr(10) || 'more' end body, case when b = 0 and rn = 1 then o_orderkey % 1000 end lines
from o, (values (0), (1)) t(b)""")
def vtt_batch_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks read by batches: a region before the first cue, a note before each other one."""
    rn, key = F.col("rn"), F.col("o_orderkey")
    opener = F.when(rn == 1, _text("REGION\nid:a\nlines:", key % 1000, "\n\n")).otherwise(_text("NOTE  ", F.col("o_orderstatus"), "\rmore\n\n"))
    settings = F.when(rn % 2 == 1, _text(" position:", rn % 100, ".25%,line-right position:x")).otherwise(_text(" line:", -rn))
    text = _text(opener, "order ", key, "\n", F.regexp_replace(_timing(rn, _vtt_time), r"\n", ""), settings, "\r\n", F.col("o_orderpriority"), "\r\n\r\n")
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus")
    found = vtt_batches.parse_vtt(_documents(_numbered(orders, "o_custkey", "o_orderkey"), "o_custkey", "rn", text, "WEBVTT\n\n"))
    s = F.col("settings")
    return found.select(
        "doc_id", F.col("ordinal").cast("long").alias("ordinal"), "block_type", "identifier", F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), s["position"]["pct"].alias("pos_pct"),
        s["position"]["align"].alias("pos_align"), s["line"]["num"].cast("long").alias("line_num"), F.regexp_replace("body", "\r", "\n").alias("body"), F.col("region")["lines"].alias("lines"),
    )
