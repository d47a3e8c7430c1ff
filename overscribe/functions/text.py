"""Text functions as Column expressions. Patterns are Unicode-aware, (?U), as the texts are in many scripts."""

from __future__ import annotations

import json
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import FLAGS, LABELS

#: Named characters of HTML, by the standard library's table: names that end in a semicolon.
NAMED = json.dumps({name[:-1]: text for name, text in html5.items() if name.endswith(";")})
#: Names that count without a semicolon too, even if more letters follow; the longest one wins.
BARE = "^(" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)) + ")"
#: What pages mean by the numbers 128 to 159: characters of Windows-1252.
C1 = "".join(map(chr, range(128, 160)))
WINDOWS = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(128, 160))
#: What a title loses, in this order, before titles are compared.
TITLE_NOISE = [
    r"【[^】]*】",
    r"\[[^\]]*\]",
    r"^[^║|｜]{0,8}[║|｜]",
    r"(19|20)\d{2}\s*(年度?|學年度?)?",
    r"\b1[0-2]\d\s*(年度?|學年度?)",
    r"[春夏秋冬](季|學期|季班)?",
    r"第?[一二三四1-4]期",
    r"\d+(st|nd|rd|th)?",
    r"(spring|summer|fall|autumn|winter)",
    r"(更正|延長|延期|截止|最新|重要|公告|活動|徵求|招募|開放|報名)",
    r"[\s\W_]+",
]
#: Readable attachments, best first, and words that mark the call itself.
READABLE = ["pdf", "docx", "odt"]
MAIN_WORDS = "簡章|辦法|要點|說明|guideline|brochure"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _drop(x: Column, pattern: str, flags: str = "U") -> Column:
    return F.regexp_replace(x, f"(?{flags}){pattern}", "")


#: Fixed value: white space of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space of SQL's patterns, and the entities that it decodes, &amp; after these.
BLANKS = "\t\n\x0c\r "
PLAIN = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·"}


def strip(x: Column | str) -> Column:
    return F.trim(_c(x), F.lit(SPACES))


def squeeze(x: Column | str) -> Column:
    """Blanks and tabs to one blank each, and none at the ends."""
    return strip(F.regexp_replace(_c(x), r"[ \t]{2,}|\t", " "))


def squeeze_plain(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(x), r"[ \t]{2,}|\t", " "), F.lit(BLANKS))


def _character(number: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0"))
    return F.translate(F.decode(utf32, "UTF-32"), C1, WINDOWS)


def unescape(x: Column | str) -> Column:
    """Entities decoded once: by number, by name, and by the start of a name that needs no semicolon. Unknown names stay."""
    named = F.from_json(F.lit(NAMED), "map<string,string>")  # folded into a constant

    def decoded(p: Column) -> Column:
        digits, hexa, name = (F.regexp_extract(p, q, 1) for q in (r"^#([0-9]{1,18});?", r"^#[xX]([0-9a-fA-F]{1,15});?", r"^([A-Za-z][A-Za-z0-9]*);"))
        rest = F.regexp_replace(p, r"^(?:#[0-9]{1,18};?|#[xX][0-9a-fA-F]{1,15};?|[A-Za-z][A-Za-z0-9]*;)", "")
        number = F.when(digits != "", digits.try_cast("long")).when(hexa != "", F.conv(hexa, 16, 10).try_cast("long"))
        text = F.when(number.isNotNull(), _character(number)).when(name != "", F.try_element_at(named, name))
        bare = F.regexp_extract(p, BARE, 1)
        by_start = F.concat(F.try_element_at(named, F.nullif(bare, F.lit(""))), F.substring(p, F.length(bare) + 1, F.length(p)))
        return F.coalesce(F.concat(text, rest), by_start, F.concat(F.lit("&"), p))

    parts = F.split(_c(x), "&")
    whole = F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(decoded(p))), "")
    return F.when(_c(x).contains("&"), whole).otherwise(_c(x))


def unescape_plain(x: Column | str) -> Column:
    """The entities of PLAIN, and &amp; with or without its semicolon, decoded; all else stays, be it another entity or the start of one."""
    return F.regexp_replace(reduce(lambda t, e: F.replace(t, F.lit(e), F.lit(PLAIN[e])), PLAIN, _c(x)), "&amp;?", "&")


def html_to_text(x: Column | str, plain: bool = False) -> Column:
    """Without scripts, styles and tags; ends of blocks are line breaks; blank lines go. A div ends no line.

    ``plain``: as SQL has it, with the entities of PLAIN only and with no white space but ASCII's.
    """
    t = F.regexp_replace(_c(x), r"(?s)<script.*?</script>|<style.*?</style>", "")
    t = F.regexp_replace(t, (rf"<br[{BLANKS}]*/?>" if plain else r"<br\s*/?>") + r"|</p>|</li>|</tr>|</h\d>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.translate(unescape_plain(t) if plain else unescape(t), "\u00a0", " ")
    lines = F.transform(F.split(t, r"\r\n|[\n\r]"), squeeze_plain if plain else squeeze)
    return F.array_join(F.filter(lines, lambda s: s != ""), "\n")


def page_header(page: Column | str) -> Column:
    """struct(title, date, author) of a bulletin page; null if it has none."""
    page = _c(page)
    pattern = r'(?s)<h3 class="page-title">(.*?)</h3>.*?title="日期"></i>\s*(\d{4}-\d{2}-\d{2}).*?title="修改人"></i>\s*([^<]*?)\s*<'
    got = [F.regexp_extract(page, pattern, i) for i in (1, 2, 3)]
    return F.when(page.rlike(pattern), F.struct(html_to_text(got[0]).alias("title"), got[1].alias("date"), strip(got[2]).alias("author")))


def page_body(page: Column | str) -> Column:
    return F.regexp_extract(_c(page), r'(?s)<div class="page-content">(.*?)<ul class="list-group">', 1)


_LINK = r'(?s)<a[^>]+href="([^"]+)"[^>]*>(.*?)</a>'


def links(fragment: Column | str) -> Column:
    """array<struct<href, label>>, without mail and script links."""
    href, label = (F.regexp_extract_all(_c(fragment), F.lit(_LINK), F.lit(i)) for i in (1, 2))
    found = F.transform(F.arrays_zip(href.alias("href"), label.alias("label")), lambda x: F.struct(x["href"].alias("href"), html_to_text(x["label"]).alias("label")))
    return F.filter(found, lambda x: ~x["href"].rlike("^(mailto:|javascript:)"))


def attachments(page: Column | str, site: str) -> Column:
    """array<struct<url, label, ext>> of the attachment box; only downloads count."""
    box = F.regexp_extract(_c(page), r'(?s)<ul class="list-group">(.*?)</ul>', 1)
    href, label = (F.regexp_extract_all(box, F.lit(_LINK), F.lit(i)) for i in (1, 2))
    rows = F.transform(F.arrays_zip(href.alias("href"), label.alias("label")), lambda x: F.struct(unescape(x["href"]).alias("href"), x["label"].alias("label")))
    rows = F.filter(rows, lambda x: x["href"].contains("download.php"))
    return F.transform(
        rows,
        lambda x: F.struct(
            F.when(x["href"].startswith("/"), F.concat(F.lit(site), x["href"])).otherwise(x["href"]).alias("url"),
            html_to_text(x["label"]).alias("label"),
            F.lower(F.regexp_extract(x["href"], r"(?U)filename=[^&]*?\.(\w+)(&|$)", 1)).alias("ext"),
        ),
    )


def pick_attachment(files: Column | str) -> Column:
    """The main readable attachment: calls before others, then by kind, then the first."""
    ranked = F.transform(
        _c(files),
        lambda x, i: F.struct(
            (~x["label"].rlike(f"(?iu){MAIN_WORDS}")).cast("int").alias("other"),
            F.array_position(F.array(*map(F.lit, READABLE)), x["ext"]).alias("kind"),
            i.alias("i"),
            x.alias("file"),
        ),
    )
    return F.array_min(F.filter(ranked, lambda x: x["kind"] > 0))["file"]


def norm_title(title: Column | str) -> Column:
    return reduce(lambda c, p: _drop(c, p, "iuU"), TITLE_NOISE, F.lower(_c(title)))


def norm_body(text: Column | str) -> Column:
    return _drop(F.regexp_replace(_c(text), r"(?U)(19|20)\d{2}|1[0-2]\d(?=\s*年)", "<Y>"), r"\s+")


def norm_section(text: Column | str) -> Column:
    return _drop(F.regexp_replace(_c(text), r"(?U)20\d{2}", "<Y>"), r"\s+")


def tokens(text: Column | str) -> Column:
    """Runs of a-z and 0-9 in lower case, then pairs of neighbours in each run of CJK characters."""
    text = _c(text)
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(text, F.lit("[㐀-鿿]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda j: F.substring(r, j, F.lit(2))))
    return F.concat(words, F.flatten(pairs))


def doc_text(title: Column | str, text: Column | str, limit: int | None = None) -> Column:
    out = F.concat(_c(title), F.lit("\n"), _c(text))
    return F.substring(out, 1, limit) if limit else out


def title_and_text(text: Column | str) -> Column:
    """struct(title, text) of a plain or Markdown file: the first line that is not blank, without #, and the rest."""

    def parts(t: Column) -> Column:
        first = F.split_part(t, F.lit("\n"), F.lit(1))
        return F.struct(F.regexp_replace(first, r"(?U)^#+\s*", "").alias("title"), F.ltrim(F.substring(t, F.length(first) + 2, F.length(t)), F.lit(SPACES)).alias("text"))

    # Bound by a lambda, so that the text is squeezed once and not once for each use.
    return F.transform(F.array(squeeze(F.coalesce(_c(text), F.lit("")))), parts)[0]


def strip_furniture(text: Column | str, min_repeats: int = 4, max_len: int = 120) -> Column:
    """Without lines that return at least so often, page numbers aside; blank lines and long ones stay.

    Each line carries its normalised form; the sorted forms tell which ones
    repeat: a form at place i that stands at i + min_repeats - 1 as well.
    """
    norm = lambda s: _drop(strip(s), r"P\s*\d+\s*$")
    lines = F.split(_c(text), r"\r\n|[\n\r]")
    forms = F.filter(F.transform(F.filter(lines, lambda s: strip(s) != ""), norm), lambda s: (s != "") & (F.length(s) <= max_len))
    s = F.sort_array(forms)
    often = F.array_distinct(F.filter(F.zip_with(s, F.slice(s, F.lit(min_repeats), F.greatest(F.size(s) - min_repeats + 1, F.lit(0))), lambda a, b: F.when(a == b, a)), lambda x: x.isNotNull()))
    # Bound by a lambda, so that it is worked out once a text and not once a line.
    kept = F.transform(F.array(often), lambda o: F.filter(lines, lambda x: ~F.coalesce(F.array_contains(o, norm(x)), F.lit(False))))
    return F.array_join(kept[0], "\n")


def safe_name(label: Column | str) -> Column:
    t = F.regexp_replace(_c(label), r'(?U)[\\/:*?"<>|\s]+', "_")
    t = F.substring(F.regexp_replace(t, r"^[._]+|[._]+$", ""), 1, 80)
    return F.coalesce(F.nullif(t, F.lit("")), F.lit("attachment"))


def edition_of(path: Column | str) -> Column:
    """struct(year, term) from a file name."""
    path = _c(path)
    term = F.when(path.contains("春"), "spring").when(path.contains("秋"), "autumn").otherwise("unknown")
    return F.struct(F.nullif(F.regexp_extract(path, r"(20\d{2})年", 1), F.lit("")).alias("year"), term.alias("term"))


def file_doc_id(title: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit("file-"), F.substring(F.md5(doc_text(title, text)), 1, 8))


def request_key(request: Column) -> Column:
    return F.sha2(F.to_json(request), 256)


def uuid5_url(name: Column | str) -> Column:
    """UUID version 5 in the namespace of URLs."""
    namespace = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))  # fixed value
    h = F.sha1(F.concat(namespace, F.encode(_c(name), "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def parse_reply(content: Column | str, with_target: bool = True) -> Column:
    """struct(quality, rationale, label, target, confidence) of a judge's reply.

    ``valid`` if the whole reply is an object that fits, ``recovered`` if the
    outermost braces hold one, else ``invalid`` with the rest null.
    """
    content = _c(content)
    schema = "rationale string, label string, target string, confidence double"
    targets = [f"C{i}" for i in range(1, 6)] + ["NONE"]

    def fits(v: Column) -> Column:
        ok = v["rationale"].isNotNull() & v["label"].isin(LABELS) & v["confidence"].between(0, 1)
        return F.coalesce(ok & v["target"].isin(targets) if with_target else ok, F.lit(False))

    def parsed(text: Column) -> Column:
        return F.from_json(text, schema, {"mode": "PERMISSIVE"})

    whole = F.when(content.rlike(r"(?s)^\s*\{.*\}\s*$"), parsed(content))
    inner = parsed(F.regexp_extract(content, r"(?s)\{.*\}", 0))
    quality = F.when(fits(whole), "valid").when(fits(inner), "recovered").otherwise("invalid")
    best = F.when(fits(whole), whole).when(fits(inner), inner)
    return F.struct(quality.alias("quality"), *(best[f].alias(f) for f in ("rationale", "label", "target", "confidence")))


def render_doc(title: Column, date: Column, text: Column, limit: int | None) -> Column:
    return F.concat(F.lit("title: "), title, F.lit("\ndate: "), date, F.lit("\n"), F.substring(text, 1, limit) if limit else text)


def render_prompt(incoming: Column, blocks: Column) -> Column:
    """``blocks``: array of rendered candidates, best first."""
    listed = F.array_join(F.transform(blocks, lambda b, i: F.concat(F.lit("[C"), (i + 1).cast("string"), F.lit("]\n"), b)), "\n\n")
    return F.concat(F.lit("INCOMING ANNOUNCEMENT\n"), incoming, F.lit("\n\nEXISTING DOCUMENTS (most similar first)\n"), F.when(F.size(blocks) > 0, listed).otherwise("(none)"))


def reason(notes: Column | str) -> Column:
    """The written reason of an annotator's notes, without parts that are only flags; empty if under 15 characters."""
    parts = F.transform(F.split(F.coalesce(_c(notes), F.lit("")), r" \| "), strip)
    flags = F.array(*map(F.lit, FLAGS))
    kept = F.array_join(F.filter(parts, lambda p: (p != "") & (F.size(F.array_except(F.split(p, r"\s+"), flags)) > 0)), " | ")
    return F.when(F.length(kept) >= 15, kept).otherwise("")


def target_hit(target: Column | str, gold: Column | str) -> Column:
    return F.coalesce(F.array_contains(F.split(F.coalesce(_c(gold), F.lit("")), r"\|"), _c(target)), F.lit(False))


def outcome(gold_label: Column, gold_target: Column, label: Column, target: Column) -> Column:
    same = gold_label == label
    return (
        F.when(same & (label != "UPDATE"), F.concat(F.lit("correct_"), F.lower(label)))
        .when(same & target_hit(target, gold_target), "correct_update")
        .when(same, "wrong_target")
        .when((label == "UPDATE") & (gold_label == "NEW"), "false_update")
        .when(gold_label == "UPDATE", "missed_update")
        .otherwise("other")
    )


def explain(gold_label: Column, gold_target: Column, label: Column, target: Column) -> Column:
    names = {"false_update": "false UPDATE", "missed_update": "missed UPDATE", "wrong_target": "wrong target", "other": "other"}
    o = outcome(gold_label, gold_target, label, target)
    verdict = F.when(o.startswith("correct"), "CORRECT")
    for k, v in names.items():
        verdict = verdict.when(o == k, f"WRONG ({v})")
    said, key = (F.concat_ws(" ", a, F.nullif(b, F.lit(""))) for a, b in ((label, target), (gold_label, gold_target)))
    return F.concat(verdict, F.lit(": said "), said, F.lit("; answer key "), key)


def pct(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.format_string("%.1f%% (%d)", 100.0 * n / total, n.cast("long"))).otherwise("–")


def run_tag(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r"(?U)[^\w.-]+", "-")


def markdown(title: Column, text: Column) -> Column:
    return F.concat(F.lit("# "), title, F.lit("\n\n"), text, F.lit("\n"))
