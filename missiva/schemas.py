"""Declared schemas of the stored tables."""

INDEX = "id string, folder string, key string, validity string, `from` string, subject string, date string, path string, sha256 string, size long, ordinal long"
HEADERS = "path string, mid string, date string, `from` string, `to` string, subject string, refs array<string>, addrs array<string>, attach boolean"
BODIES = "path string, body string, is_html boolean, attachments array<struct<position:int,name:string,size:long,is_image:boolean>>"
LINKS = "message_id string, folder string, eml string, provider string, url string, status string, file string, note string, size long, confirmed boolean, scanned boolean"
ACTION = (
    "struct<action:string,about:string,owner:string,counterparty:string,direction:string,due_raw:string,due_canonical:string,due_basis:string,recurrence:string,status:string,priority:string,"
    "confidence:string,quote:string,is_mine:boolean,due_pending:boolean,quote_unverified:boolean,implied:boolean,refs:array<string>,source:array<string>>"
)
RECORDS = (
    "thread_id string, root_id string, subject string, summary string, source struct<n:int,end:string,attach:int>, "
    "facts struct<project:string,parties:array<string>,refs:array<string>,dates:array<string>,amounts:array<struct<currency:string,value:string>>,percents:array<string>>, "
    f"tags array<string>, actions array<{ACTION}>, open_items array<string>, classification struct<domain:string,category:string,method:string,confidence:double>, ts double"
)
CONTACTS = "email string, name string, position string, company string, company_key string, domain string, phone string, count long, aliases array<string>"
RULES = "type string, match string, domain string, category string, ts double"
GOLD = "thread_id string, confirmed boolean, gold_version int, atoms map<string,array<string>>"
