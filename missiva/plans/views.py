"""Mail-like views over the order tables, in SQL that Spark and other engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MAIL_FULL = """
select ordinal, o_custkey, blk, pos, message_id, folder, sender, sent_day, size,
  case when pos = 0 then null
       when blk % 2 = 0 then first_value(message_id) over (partition by o_custkey, blk order by pos)
       else lag(message_id) over (partition by o_custkey, blk order by pos) end as reply_to,
  'Please confirm PO-' || ordinal || ' by ' || sent_day || ' for USD ' || price || '. Retention is ' || (ordinal % 10 + 1) || '%. Reply within ' || (ordinal % 30 + 1) || ' days.' as body
from (
  select o_orderkey as ordinal, o_custkey, cast(floor(rn / 4) as bigint) as blk, rn % 4 as pos,
    'm' || o_orderkey || '@c' || o_custkey || '.example' as message_id,
    case o_orderstatus when 'O' then 'INBOX' when 'F' then 'Sent' else 'Trash' end as folder,
    'user' || o_custkey || '@firm' || (o_custkey % 40) || '.example' as sender,
    cast(cast(o_orderdate as date) as string) as sent_day, cast(floor(o_totalprice) as bigint) as size, {fmt}('%.2f', o_totalprice) as price
  from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as rn from {orders}) numbered
) keyed
"""

ACTION = """
select l_orderkey as thread_id, l_linenumber, cast(cast(l_shipdate as date) as string) as due_canonical,
  case when l_linenumber % 3 = 0 then null when l_linenumber % 3 = 1 then true else false end as is_mine,
  case l_returnflag when 'R' then 'done' when 'A' then 'open' else 'waiting' end as status,
  case when l_quantity > 33 then 'high' when l_quantity > 16 then 'normal' else 'low' end as priority
from {lineitem}
"""

LINK = """
select 'm' || l_orderkey as message_id, l_orderkey, 'https://files' || (l_suppkey % 5) || '.example/p' || l_partkey as url,
  case l_suppkey % 5 when 0 then 'Box' when 1 then 'Dropbox' else 'Google Drive' end as provider,
  case l_linenumber when 1 then 'downloaded' when 2 then 'dead' else 'pending' end as status
from {lineitem}
"""

PERSON = """
select 'user' || c_custkey || '@firm' || (c_custkey % 40) || '.example' as email, c_name as name, c_custkey,
  p_name || ' ' || case c_custkey % 3 when 0 then 'Pte Ltd' when 1 then 'Limited' else 'Co Ltd' end as company, p_name
from {customer} join {part} on p_partkey = c_custkey % 40
"""

SOURCES = {"mail_full": (MAIL_FULL, ("orders",)), "action_v": (ACTION, ("lineitem",)), "link_v": (LINK, ("lineitem",)), "person_v": (PERSON, ("customer", "part"))}
#: References made of keys: as long as keys of large tables are.
KEY_DIGITS = 18
PRESENT = "not (pos = 0 and ordinal % 11 = 0)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name; ``mail_v`` is ``mail_full`` without some first messages, whose replies then point nowhere."""
    if name == "mail_v":
        return view(spark, sf_dir, "mail_full").where(PRESENT)
    text, tables = SOURCES[name]
    return spark.sql(text.format(fmt="format_string", **{t: f"{{{t}}}" for t in tables}), **{t: table(spark, sf_dir, t) for t in tables})


def with_views(query: str) -> str:
    """``query`` for another engine, with the views it names as common table expressions."""
    out = [f"{n} as ({text.format(fmt='printf', **{t: t for t in tables})})" for n, (text, tables) in SOURCES.items() if n in query or (n == "mail_full" and "mail_v" in query)]
    if "mail_v" in query:
        out.append(f"mail_v as (select * from mail_full where {PRESENT})")
    head, sep, tail = query.strip().partition("with ")
    extra = tail if not head and sep else ""
    loops = "recursive " if extra.startswith("recursive ") else ""
    extra = extra.removeprefix("recursive ")
    return f"with {loops}{', '.join(out)}{', ' + extra if extra else ' ' + query}" if out else query
