"""Registered queries of signatures, firms and people, with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.functions.signature import with_signatures
from missiva.operators import directory, people
from missiva.plans.queries import QUERIES, SQL, query  # noqa: F401
from missiva.plans.views import table
from missiva.session import materialize

# What each customer's letter says, as plain columns; Spark finds the same again in the letter.
SENDERS = """
select i, kind, case when i % 11 = 0 then 'gmail.com' else 'acme' || n || '.example' end as domain, case when kind in (2, 3) then 'projects' || i || '@' else 'u' || i || '@' end as local, 
  case when kind in (2, 3) then '' else 'Kim ' || translate(cast(i as varchar), '0123456789', 'abcdefghij') end as name,
  case kind when 0 then 'Acme' || n || ' Holdings Pte Ltd' when 1 then 'Vendor Works Ltd' when 2 then 'Acme' || n || ' Singapore Limited' when 3 then 'Brand Works LLC' else '' end as company,
  case kind when 0 then 'acme' || n || 'holdings' when 1 then 'vendorworks' when 2 then 'acme' || n || 'singapore' when 3 then 'brandworks' else '' end as key,
  case when kind = 4 then '' when i % 3 = 0 then 'Senior Project Manager' when i % 3 = 1 then 'Director' else 'Site Engineer' end as position,
  case when kind = 4 then '' else '+65 9' || substr(lpad(cast(i as varchar), 7, '0'), 1, 3) || ' ' || substr(lpad(cast(i as varchar), 7, '0'), 4) end as phone
from (select c_custkey as i, c_custkey % 5 as kind, cast(floor(c_custkey / 5) as bigint) % 40 as n from customer) c"""
GREETINGS, CLOSES = "array('Dear Hooli Holdings Pte Ltd,', 'Hi all', 'To: whom it may concern', '')", "array('Best regards,', 'Rgds', 'Thanks & Regards', 'Yours faithfully,')"


def letters(spark: SparkSession, sf: str) -> DataFrame:
    """One letter a customer: a greeting that names another firm, a signature in changing layouts, a quoted letter of somebody else."""
    rows = spark.sql(SENDERS.replace("from customer", "from {customer}").replace("varchar", "string"), customer=table(spark, sf, "customer"))
    signed = F.when(F.col("kind") == 0, F.col("name")).when(F.col("kind") == 1, "Gary Lim").otherwise("Support Team")
    wrapped = (F.col("i") % 2 == 0) & (F.col("kind") == 0)
    shown = F.when(wrapped, F.regexp_replace("company", " Pte Ltd", "\nPte Ltd")).when(F.col("i") % 4 == 1, F.concat(F.lit("* for "), "company", F.lit(", *"))).otherwise(F.col("company"))
    close = F.element_at(F.expr(CLOSES), (F.col("i") % 4 + 1).cast("int"))
    number = F.when(F.col("i") % 3 == 0, F.concat(F.lit("Office fax +65 6000 0000\nMobile: "), "phone", F.lit("\n6111 2222 3333"))).otherwise(F.concat(F.lit("Fax +65 6000 0000\nHP "), "phone"))
    block = F.concat_ws("\n", close, signed, "position", shown, number, F.lit("This e-mail is confidential; if received in error please notify Umbrella Pte Ltd"))
    greeting = F.element_at(F.expr(GREETINGS), (F.col("i") % 4 + 1).cast("int"))
    text = F.concat_ws("\n", greeting, F.lit("Please see the attached."), F.when(F.col("kind") == 4, "Noted").otherwise(block), F.lit("On Monday, Bob wrote:\n> Regards,\n> Gary\n> Initech Pte Ltd\n> Mobile: +65 8000 1111"))
    return rows.select("i", F.concat("local", "domain").alias("email"), "name", text.alias("body"))


@query(f"""
select local || domain as email, case kind when 4 then '' else company end as company, position, phone, case when kind = 0 then name when kind = 1 then 'Gary Lim' else '' end as signed from ({SENDERS}) s where kind <> 4
union all select local || domain, '', '', '', 'Noted' from ({SENDERS}) s where kind = 4""")
def signatures(spark, sf):
    """Company, title, number and name in every letter's signature."""
    return with_signatures(letters(spark, sf)).select("email", "company", "position", "phone", "signed")


@query(f"""
with s as (select *, kind = 0 as own from ({SENDERS}) x),
voters as (select * from s where company <> '' and kind <> 1),
votes as (select key, domain, count(*) as n from voters group by key, domain),
kept as (select v.*, own or votes.n = (select max(n) from votes m where m.key = v.key) as good from voters v join votes on votes.key = v.key and votes.domain = v.domain),
named as (select domain, company, key, count(*) as n, bool_or(own) as own from kept where good and domain <> 'gmail.com' group by domain, company, key),
firm as (select domain, company, row_number() over (partition by domain order by n < 2, length(company) < 6, n desc, length(company) desc, company) as k from named
  where own or n >= 2 or contains(key, split_part(domain, '.', 1)))
select s.local || s.domain as email, s.name, case when s.domain = 'gmail.com' then '' when s.own then s.company else coalesce(firm.company, '') end as company,
  case when s.domain = 'gmail.com' then '' else s.domain end as host, case when kept.good then s.position else '' end as position, case when kept.good then s.phone else '' end as phone
from s left join firm on firm.domain = s.domain and k = 1 left join kept on kept.i = s.i""")
def signed_directory(spark, sf):
    """The directory that the letters make: own signatures first, then what a domain's people call their firm."""
    mail = letters(spark, sf).withColumnRenamed("i", "ordinal").withColumn("count", F.lit(1))
    found = materialize(with_signatures(mail.select("email", "body")), "signatures")
    book = people.signed_directory(mail.select("email", "name", "count", "ordinal"), found)
    return book.select("email", "name", "company", F.when(F.col("company_key") != "", F.col("domain")).otherwise("").alias("host"), "position", "phone")


@query("""
select 'p' || c_custkey || '@firm.example' as email, 8 as count, 'QS' as position, 'old@x|p' || c_custkey || 'ab@firm.example' as aliases from customer where c_custkey % 2 = 1
union all select 'p' || c_custkey || 'ab@firm.example', 10, 'QS', 'p' || c_custkey || '@firm.example|old@x|p' || c_custkey || 'abcd@firm.example' from customer where c_custkey % 2 = 0
union all select 'p' || c_custkey || 'abcd@firm.example', 2, '', '' from customer where c_custkey % 2 = 1""")
def folded_people(spark, sf):
    """Three addresses of one person, each two edits from the next: the busiest takes those that are like it, and likeness does not carry over."""
    name = F.concat(F.lit("Person "), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))
    rows = table(spark, sf, "customer").select("c_custkey", name.alias("name"))
    middle = F.col("c_custkey") % 2 == 0

    def address(end, count, position, aliases, ordinal):
        return rows.select(F.concat(F.lit("p"), "c_custkey", F.lit(f"{end}@firm.example")).alias("email"), "name", count.alias("count"), F.lit(position).alias("position"), aliases.cast("array<string>").alias("aliases"), F.lit(ordinal).alias("ordinal"))

    busiest = address("", F.when(middle, 3).otherwise(5), "", F.array(F.lit("old@x")), 1).unionAll(address("ab", F.when(middle, 5).otherwise(3), "QS", F.array(), 2)).unionAll(address("abcd", F.lit(2), "", F.array(), 3))
    folded = people.fold_people(busiest, filled=("position",))
    return folded.select("email", "count", "position", F.array_join("aliases", "|").alias("aliases"))


@query("""
with f as (select p_partkey, case p_partkey % 10 when 7 then 'AB2' when 8 then 'AB22' else 'AB' || case when p_partkey % 2 = 0 then 'C' else '' end end as base from part),
r as (select *, row_number() over (partition by base order by p_partkey) as k from f)
select count(*) as firms, count(distinct p_partkey) as codes, 0 as repeated, sum(case when base = 'ABC' then 1 else 0 end) as plain from r""")
def codes_without_repeats(spark, sf):
    """Codes whose own digits meet the numbers of others: as many codes as firms; a base that nothing meets counts through."""
    k = F.col("p_partkey") % 10
    base = F.when(k == 7, "AB2").when(k == 8, "AB22").otherwise(F.concat(F.lit("AB"), F.when(k % 2 == 0, "C").otherwise("")))
    coded = materialize(directory.unique_codes(table(spark, sf, "part").select("p_partkey", base.alias("code")), order="p_partkey"), "coded")
    taken = coded.groupBy("unique_code").agg(F.count("*").alias("n"))
    numbers = coded.where("code = 'ABC'").select(F.coalesce(F.expr("try_cast(nullif(substring(unique_code, 4), '') as int)"), F.lit(1)).alias("n"))
    counts = taken.agg(F.sum("n").alias("firms"), F.count("*").alias("codes"), F.count_if(F.col("n") > 1).alias("repeated"))
    return counts.crossJoin(numbers.agg(F.max("n").alias("plain")))  # one row each
