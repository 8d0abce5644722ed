"""Raw message files: headers, bodies, attachments."""

from __future__ import annotations

import email
import re
from email import policy
from email.parser import BytesHeaderParser
from email.utils import getaddresses
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.functions.mail import to_utc
from missiva.schemas import BODIES, HEADERS


def _ids(value) -> list[str]:
    return [x.strip("<> \t").lower() for x in re.findall(r"<[^>]+>", str(value or ""))]


#: A line of plain text, a plain message id, and one plain address with or without a name before it: their parts need no parser.
PLAIN, PLAIN_ID = re.compile(r"(?!.*=\?)[!-~](?:[ -~]*[!-~])?"), re.compile(r"<[A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*@[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*>")
NAMED = re.compile(r"([A-Za-z0-9 =?_.'-]*)<([A-Za-z0-9]+(?:[._+-][A-Za-z0-9]+)*@[A-Za-z0-9]+(?:[.-][A-Za-z0-9]+)*)>")
STAND_IN = "someone@there.example"
HEADER_NAMES = ("From", "To", "Subject", "Content-Type", "Message-ID", "Date", "In-Reply-To", "References")


@lru_cache(20_000)
def _parsed(name: str, value: str) -> str:
    return str(policy.default.header_fetch_parse(name, value))


def _header(name: str, value: str) -> str:
    """A header's text as the library has it. Most of a parser's time is saved: values recur, plain ones are what they say, and of an address only the name before it is parsed."""
    if name in ("subject", "in-reply-to", "references"):
        whole = "".join(re.split(r"\r\n|\r|\n", value))
        if PLAIN.fullmatch(whole):
            return whole
    elif name == "message-id" and PLAIN_ID.fullmatch(value):
        return value
    elif name in ("from", "to") and (named := NAMED.fullmatch(value)):
        told = _parsed(name, f"{named[1]}<{STAND_IN}>")
        if told.count(STAND_IN) == 1:
            return told.replace(STAND_IN, named[2])
    return _parsed(name, value)


def header_row(path: str, raw: bytes) -> dict:
    """The headers of one message as they are written, but for ids and addresses."""
    m: dict[str, str] = {}
    for name, value in BytesHeaderParser(policy=policy.default).parsebytes(raw).raw_items():
        m.setdefault(name.lower(), value)
    m = {k: _header(k.lower(), m[k.lower()]) for k in HEADER_NAMES if k.lower() in m}
    said = {k: m.get(k, "") for k in ("From", "To", "Subject", "Content-Type")}
    addresses = [a.strip().lower() for _, a in getaddresses([said["From"], said["To"]]) if "@" in a]
    return {
        "path": path, "mid": (_ids(m.get("Message-ID")) or [""])[0], "date": str(m.get("Date", "") or ""), "from": said["From"], "to": said["To"], "subject": said["Subject"],
        "refs": _ids(m.get("In-Reply-To")) + _ids(m.get("References")), "addrs": list(dict.fromkeys(addresses)), "attach": "multipart/mixed" in said["Content-Type"].lower(),
    }


def _is_attachment(part, shown: set[str]) -> bool:
    """A file, and no image that stands in the text: by its disposition, else by a content id that the body shows, else by a file name."""
    said, image = part.get_content_disposition(), part.get_content_maintype() == "image"
    if said is not None:
        return said == "attachment" or not image
    cid = str(part.get("Content-ID", "") or "").strip("<> ")
    return cid not in shown if cid and image else bool(part.get_filename())


def _body_row(path: str, raw: bytes) -> dict:
    m = email.message_from_bytes(raw, policy=policy.default)
    part = m.get_body(preferencelist=("html", "plain"))
    body = "" if part is None else part.get_content()
    is_html = part is not None and part.get_content_subtype() == "html"
    shown = {c.strip("<> ") for c in re.findall(r"cid:([^\s\"'>)]+)", body, re.I)} if is_html else set()
    found = []
    for p in m.iter_attachments():
        if not _is_attachment(p, shown):
            continue
        data = p.get_payload(decode=True) or b""
        found.append({"position": len(found), "name": p.get_filename() or "attachment", "size": len(data), "is_image": p.get_content_maintype() == "image"})
    return {"path": path, "body": body, "is_html": is_html, "attachments": found}


def message_files(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """path, length, modificationTime and content; the content is read only if it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def unreadable(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """The files that a projection left out."""
    return files.select("path").join(parsed.select("path"), "path", "left_anti")


def _project(files: DataFrame, row, schema: str) -> DataFrame:
    columns = [f.strip("`") for f in re.findall(r"(?:^|, )(`?\w+`?) ", re.sub(r"<.*?>(?=,|$)", "", schema))]

    def run(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows.append(row(path, content))
                except (LookupError, ValueError, TypeError, AttributeError):  # an unknown charset, a broken header: the file is left out
                    continue
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def headers(files: DataFrame) -> DataFrame:
    """The headers that threading needs, one row per readable file; unreadable dates are null."""
    return _project(files, header_row, HEADERS).withColumn("date", to_utc(F.col("date")))


def bodies(files: DataFrame) -> DataFrame:
    """Preferred body (HTML, then plain) and real attachments; images that the body shows are none."""
    return _project(files, _body_row, BODIES)


def index(files: DataFrame, parsed: DataFrame, folder: str = "INBOX") -> DataFrame:
    """Message index with content digest; messages without id get ``uid_`` and the digest's start."""
    sized = files.select("path", "length", F.sha2("content", 256).alias("sha256"))
    rows = parsed.join(sized, "path")
    return rows.select(
        F.when(F.col("mid") == "", F.concat(F.lit("uid_"), F.substring("sha256", 1, 12))).otherwise(F.col("mid")).alias("id"), F.lit(folder).alias("folder"), "from", "subject", "date", "path",
        F.col("length").alias("size"), "sha256",
    )


def attachment_text(files: DataFrame, most: int = 500_000) -> DataFrame:
    """Text of plain-text files up to ``most`` characters; other types are kept with a note."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    readable = kind.isin("txt", "csv", "md", "log")
    return files.select(
        "path", F.when(readable, F.substring(F.decode("content", "UTF-8"), 1, most)).alias("text"), readable.alias("ok"),
        F.when(~readable, F.concat(F.lit("not read: ."), kind)).when(F.length("content") > most, "cut").otherwise("").alias("note"),
    )
