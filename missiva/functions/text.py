"""Text clean-up, masking, sensitivity and obligation cues."""

from __future__ import annotations

from html.entities import name2codepoint

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from missiva.functions.atoms import MONTHS, extract_dates
from missiva.functions.steps import once

# Sensitivity cues and classes, obligation cues by category.
SENSITIVITY = {
    "without-prejudice": ("without prejudice", "调解"),
    "privileged": ("privileged", "legally privileged", "attorney-client", "solicitor-client", "work product", "litigation privilege"),
    "confidential": ("strictly confidential", "private and confidential", "do not disclose", "保密", "不得披露"),
    "personal-data": (
        "medical record", "patient", "diagnosis", "date of birth", "nric", "passport no", "national id", "身份证", "病历", "dob", "mrn", "accession", "member id", "policy no",
        "medical record no", "phi", "protected health information", "hipaa", "prior authorization", "prior auth", "subscriber id", "explanation of benefits",
    ),
}
REQUESTS = (
    "please", "kindly", "could you", "can you", "request", "ensure", "make sure", "confirm", "provide", "submit", "send ", "approve", "sign ", "pay ", "release ", "furnish", "endorse", "expedite",
    "revert", "advise", "follow up", "action required", "respond", "reply", "arrange", "prepare", "complete the", "fill in", "fill out", "reschedule", "schedule a", "schedule the", "set up a", "book a",
    "set a time", "revise", "rework", "redo", "amend", "another round", "another pass", "sign off", "sign-off", "turn around", "circle back", "loop in", "action this", "tweak", "polish", "punch up",
    "take a look", "eyes on", "bigger", "smaller", "bolder", "tighter", "brighter", "warmer", "lose the", "swap the", "move the", "bring up", "overdue", "past due", "remit", "balance due", "amount due",
    "outstanding amount", "outstanding balance", "outstanding invoice", "short-paid", "withhold payment", "credit note", "waiting on", "still waiting", "chasing", "awaiting", "yet to receive",
    "outstanding from", "ship it", "go ahead", "go live", "publish", "push live",
    "请", "麻烦", "务必", "需要", "需", "应当", "应", "提交", "确认", "批准", "审批", "回复", "提供", "安排", "签署", "盖章", "付款", "落实", "尽快", "修改", "重做", "改期", "跟进", "处理", "逾期未付", "拖欠", "欠款",
    "仍在等", "等候", "催",
)
DUTIES = ("must ", "shall ", "need to", "needs to", "required to", "have to", "has to", "is to ", "are to ", "obligated", "responsible for")
WAIVERS = (
    "failing which", "failure to", "will be deemed", "deemed to", "or else", "struck out", "debarred", "dismissed", "peremptory", "in default", "deemed admitted", "judgment in default",
    "否则", "逾期", "视为放弃", "缺席判决",
)
DEADLINES = ("due ", "deadline", "within ", "no later than", "asap", "eod", "cob", "on or before", "截止", "期限", "不迟于", "天内", "日内", "工作日内")
WEAK_REQUESTS = ("review", "update", "return ", "issue ", "proceed", "attend", "schedule", "verify", "escalate")
WEAK_DEADLINES = ("by ", "before ", "end of", "之前", "以前")
COURTESY = ("thank", "thanks", "regards", "appreciate", "fyi", "no action", "谢谢", "感谢", "辛苦")
QUESTION_LEADS = "do|does|did|are|is|am|can|could|will|would|should|have|has|when|where|what|which|who|why|how|wdyt|thoughts"
SENTENCE_ENDS = "[.!?;\n。！？；]+"
QUESTION_MARKS = ("是否", "能否", "可否", "请问", "吗")
# Identifiers that are masked, in this order.
MASKS = (
    (r"(?i)\bMRN[:#\s-]*\d{3,}\b", "[MRN]"),
    (r"(?i)\b(?:DOB|date of birth)[:\s]*[\d/.\- ]{6,12}", "[DOB]"),
    (r"\b[STFG]\d{7}[A-Z]\b", "[NRIC]"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[EMAIL]"),
    (r"(?i)\b(?:member|subscriber|policy|accession)\s*(?:id|no\.?|#)?[:\s#-]*[A-Z0-9]{4,}\b", "[ID]"),
    (r"\b\+?\d[\d().\s-]{7,}\d\b", "[PHONE]"),
)


def mask_identifiers(text: Column) -> Column:
    """Pattern-detectable identifiers replaced by tags; null stays empty."""
    out = F.coalesce(text, F.lit(""))
    for pattern, tag in MASKS:
        out = F.regexp_replace(out, f"(?U){pattern}", tag)
    return out


def decode_entities(text: Column) -> Column:
    """Character references decoded once: the named ones of HTML 4 and apos, decimal and hexadecimal ones; a no-break space becomes a blank."""
    named = {f"&{name};": chr(code) for name, code in name2codepoint.items()} | {"&apos;": "'", "&nbsp;": " "}
    table = F.create_map(*(F.lit(x) for kv in named.items() for x in kv))
    parts = F.split(F.coalesce(text, F.lit("")), r"(?=&[#A-Za-z0-9]{2,10};)|(?<=;)")

    def decoded(token: Column) -> Column:
        number = F.regexp_extract(token, r"(?i)^&#(?:x([0-9a-f]{1,6})|(\d{1,7}));$", 2).try_cast("int")
        hexadecimal = F.regexp_extract(token, r"(?i)^&#x([0-9a-f]{1,6});$", 1)
        code = F.coalesce(number, F.when(hexadecimal != "", F.conv(hexadecimal, 16, 10).try_cast("int")))
        usable = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(~F.startswith(token, F.lit("&")), token).when(usable, F.when(code == 160, " ").otherwise(char)).otherwise(F.coalesce(F.try_element_at(table, token), token))

    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(parts, decoded), "")).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments dropped, breaks and block ends as new lines, entities decoded, blanks squeezed."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|tr|li|h[1-6]|table|ul|ol|article|section|nav|head|title)\s*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    out = decode_entities(out)
    out = F.regexp_replace(out, r"[ \t\x0B\f\r]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"\n{2,}", "\n"), F.lit(" \n"))


def _quoted(words: tuple[str, ...]) -> str:
    """Pattern of any of the words, shared beginnings once: a place in a text is tried by few branches instead of by every word."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        ways = [("\\" + c if c in r"\.-[](){}*+?|^$" else c) + pattern(rest) for c, rest in node.items() if c]
        if not ways:
            return ""
        return f"(?:{'|'.join(ways)})?" if "" in node else ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return pattern(tree)


def sensitivity(text: Column) -> Column:
    """Sorted sensitivity classes: ASCII cues as whole words, others contained."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = []
    for name, cues in SENSITIVITY.items():
        plain, other = tuple(c for c in cues if c.isascii()), tuple(c for c in cues if not c.isascii())
        pattern = rf"(?U)\b(?:{_quoted(plain)})\b" + (f"|{_quoted(other)}" if other else "")
        hits.append(F.when(low.rlike(pattern), F.lit(name)))
    return F.array_sort(F.array_compact(F.array(*hits)))


def has_cue(text: Column, cues: tuple[str, ...]) -> Column:
    """Does the lower-cased text contain any cue?"""
    return F.lower(F.coalesce(text, F.lit(""))).rlike(_quoted(cues))


def sentences(text: Column) -> Column:
    """Trimmed sentences of at least 3 characters."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_ENDS), lambda s: F.trim(s, F.lit(" \t\r")))
    return F.filter(parts, lambda s: F.char_length(s) >= 3)


# Words of a precondition.
PRECONDITIONS = (
    "required before", "precondition", "prerequisite", "prior to", "before handover", "cannot proceed until", "needed before", "must be completed before", "is a condition of",
    "before we can", "before it can", "before sign-off", "before go-live", "的前提", "之前完成", "视为放弃", "逾期", "须先", "先决条件",
)


#: Classes of cues; ``cues`` of a sentence has the bit of each class of which it holds a cue. A lead counts wherever a sentence begins with its letters.
CUES = {
    "request": REQUESTS, "duty": DUTIES, "waiver": WAIVERS, "due": DEADLINES, "mark": QUESTION_MARKS, "weak": WEAK_REQUESTS, "by": WEAK_DEADLINES, "courtesy": COURTESY, "before": PRECONDITIONS,
    "lead": tuple(QUESTION_LEADS.split("|")),
}
#: What a sentence with a date holds, in lower case: its bit follows those of the classes.
DATE_HINT = rf"年|[-/.．]\p{{Nd}}{{1,2}}[-/.．]\p{{Nd}}|(?:{'|'.join(MONTHS)})(?s:.*)\p{{Nd}}{{4}}"


def _cued(texts: pa.Array) -> pa.Array:
    """The sentences of each text and their cues; Arrow's patterns look for all words of a class in one pass."""
    parts = pc.split_pattern_regex(texts, SENTENCE_ENDS)
    said, owner = pc.utf8_trim(pc.list_flatten(parts), " \t\r"), pc.list_parent_indices(parts)
    kept = pc.greater_equal(pc.utf8_length(said), 3)
    said, owner = said.filter(kept), owner.filter(kept)
    low = pc.utf8_lower(pc.replace_substring(said, "\u0130", "i\u0307"))  # as Java lowers it
    bits = np.zeros(len(said), np.int32)
    patterns = [f"^{_quoted(words)}" if kind == "lead" else _quoted(words) for kind, words in CUES.items()]
    for k, pattern in enumerate([*patterns, DATE_HINT]):
        bits |= pc.match_substring_regex(low, pattern).to_numpy(zero_copy_only=False).astype(np.int32) << k
    ends = np.cumsum(np.bincount(owner.to_numpy(), minlength=len(texts)))
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([said, pa.array(bits)], names=["s", "cues"]))


def cued_sentences(text: Column) -> Column:
    """``{s, cues}`` of every sentence: those of ``sentences``, and the bits of its classes of cues."""
    find = F.arrow_udf(_cued, "array<struct<s:string,cues:int>>")
    return find(F.make_valid_utf8(F.coalesce(text, F.lit(""))))


def _has(x: Column, *kinds: str) -> Column:
    """Has a sentence a cue of any of the classes?"""
    return x["cues"].bitwiseAND(F.lit(sum(1 << k for k, kind in enumerate((*CUES, "date")) if kind in kinds))) != 0


def obligation_candidates(text: Column, cued: Column | None = None) -> Column:
    """``{text, cues, has_deadline}`` of every sentence with a strong obligation signal (``cued``: the text's sentences, if they are known).

    Every signal of a sentence is worked out once; dates are looked for only where there may be one.
    """
    due = lambda x: _has(x, "due") | (_has(x, "date") & (F.size(extract_dates(x["s"])) > 0))
    asks = lambda x: _has(x, "mark") | (_has(x, "lead") & F.lower(x["s"]).rlike(rf"(?U)^({QUESTION_LEADS})\b"))
    judged = F.transform(cued_sentences(text) if cued is None else cued, lambda x: F.struct(x["s"].alias("s"), x["cues"].alias("cues"), due(x).alias("due"), asks(x).alias("asks")))
    strong = F.filter(judged, lambda x: _has(x, "request", "duty", "waiver") | x["due"] | x["asks"])

    def told(x: Column) -> Column:
        dated = x["due"] | _has(x, "by")
        flags = {
            "courtesy": _has(x, "courtesy"), "deadline": dated, "obligation": _has(x, "duty"), "question": x["asks"],
            "request": _has(x, "request", "weak") | x["asks"], "waiver": _has(x, "waiver"),
        }
        cues = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in flags.items())))
        return F.struct(F.substring(x["s"], 1, 200).alias("text"), cues.alias("cues"), dated.alias("has_deadline"))

    return F.transform(strong, told)


def implied_candidates(text: Column, cued: Column | None = None) -> Column:
    """``{text, cues}`` of every sentence that states a precondition, with the first date of the whole text, each once (``cued``: the text's sentences, if they are known)."""
    stated = F.array_distinct(F.transform(F.filter(cued_sentences(text) if cued is None else cued, lambda x: _has(x, "before")), lambda x: F.substring(x["s"], 1, 160)))
    due = F.coalesce(F.concat(F.lit(" — by "), F.try_element_at(extract_dates(text), F.lit(1))), F.lit(""))
    told = lambda found, end: F.transform(found, lambda s: F.struct(F.concat(s, end).alias("text"), F.array(F.lit("implied")).alias("cues")))
    return once(stated, lambda found: once(F.when(F.size(found) > 0, due).otherwise(""), lambda end: told(found, end)))


def soft_candidates(text: Column, found: Column | None = None, cued: Column | None = None) -> Column:
    """``{text, cues, has_deadline}`` of every sentence with a weak request that is neither a strong candidate (``found``, if they are known) nor a courtesy (``cued``: the text's sentences, if they are known)."""
    cued = cued_sentences(text) if cued is None else cued
    weak = F.transform(F.filter(cued, lambda x: _has(x, "weak") & ~_has(x, "courtesy")), lambda x: F.substring(x["s"], 1, 200))
    strong = F.transform(obligation_candidates(text, cued) if found is None else found, lambda x: x["text"])
    left = once(F.struct(weak.alias("weak"), strong.alias("strong")), lambda x: F.filter(x["weak"], lambda s: ~F.array_contains(x["strong"], s)))
    return F.transform(left, lambda s: F.struct(s.alias("text"), F.array(F.lit("soft")).alias("cues"), F.lit(False).alias("has_deadline")))
