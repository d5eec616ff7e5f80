"""Text functions: paths, fences, sections, templates, credentials, ids."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modelyard.functions import let

# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Section markers, file blocks, default summary.
SECTION_MARK = r"(?dU)===\s*FILE:\s*(.+?)\s*===|===\s*SUMMARY\s*==="
FILE_BLOCK = r"(?sU)(?:#{1,4}\s*)?(?<!\w)\w++\.(?:py|yaml|yml|txt)\s*\n```\w*\n.*?```"
FILE_BLOCK_NAME = r"(?U)(\w+\.\w+)"
FILE_BLOCK_BODY = r"(?sU)```\w*\n(.*)```\z"
DEFAULT_SUMMARY = "Code generated successfully"

# Messages that point at the infrastructure, not at the code.
INFRASTRUCTURE_MARKS = ("ImageNotFound", "No such image", "Docker daemon", "docker.errors.APIError")

# Credential form.
CREDENTIAL_MIN_LENGTH = 20
CREDENTIAL_PREFIX = "AIza"


def strip(c: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def shown(c: Column) -> Column:
    """A value as text; a missing one reads None."""
    return F.coalesce(c.cast("string"), F.lit("None"))


# ---- paths


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def parent_dir(relative_path: Column) -> Column:
    """Directory of a path relative to the root; `.` at the root."""
    parent = F.regexp_extract(relative_path, r"\A(.*)/[^/]*\z", 1)
    return F.when(parent == "", ".").otherwise(parent)


def below(path: Column, root: str) -> Column:
    """A path relative to the root, scheme removed."""
    bare = F.regexp_replace(path, r"\A[a-zA-Z][a-zA-Z0-9+.-]*:/+", "/")
    clean = "/" + root.split(":", 1)[-1].strip("/") + "/" if root.strip("/") else "/"
    return F.when(F.startswith(bare, F.lit(clean)), F.substring(bare, len(clean) + 1, 1 << 30)).otherwise(bare)


def url_path(url: Column) -> Column:
    """Path part of a URL without its leading slash, query and fragment."""
    return F.regexp_extract(url, r"\A[a-zA-Z]+://[^/?#]*/([^?#]*)", 1)


# ---- sections and fences


def strip_fences(c: Column) -> Column:
    """Drop an opening fence line and a closing one."""
    opened = F.regexp_replace(c, r"\A[^\S\n]*```[^\n]*(?:\n|\z)", "")
    return F.regexp_replace(opened, r"(?:\A|\n)[^\S\n]*```[^\S\n]*\z", "")


def _last_of_each(files: Column) -> Column:
    """Of files with the same name keep the last, in the order of the files; sorted by name to find it."""

    def ends_its_name(by_name: Column) -> Column:
        return F.filter(by_name, lambda f, i: ~F.coalesce(F.get(by_name, i + 1)["name"] == f["name"], F.lit(False)))

    numbered = F.transform(files, lambda f, i: F.struct(f["name"].alias("name"), i.alias("at"), f["content"].alias("content")))
    last = let(F.array_sort(numbered), ends_its_name)
    in_order = F.array_sort(F.transform(last, lambda f: F.struct(f["at"].alias("at"), f["name"].alias("name"), f["content"].alias("content"))))
    return F.transform(in_order, lambda f: F.struct(f["name"].alias("name"), f["content"].alias("content")))


def _sections(raw: Column) -> Column:
    """Text between markers as array<struct<name,body>>; a summary has an empty name."""
    names = F.regexp_extract_all(raw, F.lit(SECTION_MARK), F.lit(1))
    bodies = F.split(raw, SECTION_MARK, -1)
    return let(
        bodies,
        lambda b: F.zip_with(
            names,
            F.slice(b, F.lit(2), F.size(b)),
            lambda name, body: F.struct(strip(name).alias("name"), strip(body).alias("body")),
        ),
    )


def _files_of(sections: Column) -> Column:
    named = F.filter(
        sections,
        lambda s: s["name"].contains(".") & (F.length(s["name"]) < 50) & ~s["name"].contains("==="),
    )
    files = F.transform(
        named, lambda s: F.struct(s["name"].alias("name"), strip_fences(s["body"]).alias("content"))
    )
    return _last_of_each(F.filter(files, lambda f: f["content"] != ""))


def _summary_of(sections: Column) -> Column:
    summaries = F.filter(sections, lambda s: s["name"] == "")
    return F.coalesce(F.try_element_at(summaries, F.lit(-1))["body"], F.lit(DEFAULT_SUMMARY))


def delimited(raw: Column) -> Column:
    """`=== FILE: name ===` sections as struct<files array<struct<name,content>>, summary>.

    The summary is the text after the last `=== SUMMARY ===`, or the default.
    """
    return let(
        _sections(raw),
        lambda s: F.struct(_files_of(s).alias("files"), _summary_of(s).alias("summary")),
    )


def fenced_files(raw: Column) -> Column:
    """Fenced blocks that follow a file name, as array<struct<name,content>>."""
    blocks = F.regexp_extract_all(raw, F.lit(FILE_BLOCK), F.lit(0))
    return _last_of_each(
        F.transform(
            blocks,
            lambda b: F.struct(
                F.regexp_extract(b, FILE_BLOCK_NAME, 1).alias("name"),
                strip(F.regexp_extract(b, FILE_BLOCK_BODY, 1)).alias("content"),
            ),
        )
    )


def several_files(raw: Column) -> Column:
    """Sections between markers, or fenced blocks where there are none."""
    return let(
        delimited(raw),
        lambda d: F.struct(
            F.when(F.size(d["files"]) > 0, d["files"]).otherwise(fenced_files(raw)).alias("files"),
            d["summary"].alias("summary"),
        ),
    )


def strip_json_fence(c: Column) -> Column:
    """The JSON text inside one code fence."""
    opened = F.regexp_replace(strip(c), r"\A(?:```json)?(?:```)?", "")
    return strip(F.regexp_replace(opened, r"```\z", ""))


def parse_json(c: Column, schema: T.StructType) -> Column:
    """Typed JSON; text that does not parse is kept in field `bad`."""
    typed = T.StructType([*schema.fields, T.StructField("bad", T.StringType())])
    return F.from_json(c, typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})


def strip_front_matter(c: Column) -> Column:
    """Body of a text that opens with a `---` header."""
    parts = F.split(c, "---", 3)
    return F.when(F.startswith(c, F.lit("---")) & (F.size(parts) >= 3), strip(F.get(parts, F.lit(2)))).otherwise(c)


# ---- counts, rendering


def line_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1


def render_map(m: Column, emphasis: str = "") -> Column:
    """`- key: value` lines; emphasis `**` gives the question-and-answer form."""
    return F.array_join(
        F.transform(
            F.map_entries(m),
            lambda e: F.concat(F.lit(f"- {emphasis}"), e["key"], F.lit(f"{emphasis}: "), shown(e["value"])),
        ),
        "\n",
    )


def fill_template(template: str, **values: Column) -> Column:
    """A `{name}` template with columns in its slots."""
    pieces: list[Column] = []
    for text, slot, _, _ in Formatter().parse(template):
        if text:
            pieces.append(F.lit(text))
        if slot is not None:
            pieces.append(shown(values[slot]))
    return F.concat(*pieces)


# ---- predicates


def contains_any(c: Column, marks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | c.contains(mark)
    return found


def error_kind(log: Column, marks: tuple[str, ...] = INFRASTRUCTURE_MARKS) -> Column:
    """`infrastructure` when any of the marks occurs, case sensitive, else `code`."""
    return F.when(contains_any(log, marks), "infrastructure").otherwise("code")


# ---- credentials


def credential_ok(key: Column) -> Column:
    """Long enough after trimming; a missing key is not."""
    return F.coalesce(F.length(strip(key)) >= CREDENTIAL_MIN_LENGTH, F.lit(False))


def credential_expected_prefix(key: Column) -> Column:
    return F.coalesce(F.startswith(strip(key), F.lit(CREDENTIAL_PREFIX)), F.lit(False))


def mask(key: Column, head: int = 2, tail: int = 2) -> Column:
    """First and last characters only; a key too short to hide anything shows none."""
    return F.when(F.length(key) <= 2 * (head + tail), F.lit("...")).otherwise(
        F.concat(F.left(key, F.lit(head)), F.lit("..."), F.right(key, F.lit(tail)))
    )


# ---- ids


def build_id(prefix: str, at: Column, unique: Column) -> Column:
    """`prefix-YYYYMMDD-HHMMSS-xxxxxxxx`; a time without a zone is written as it stands."""
    digits = F.regexp_replace(F.left(at.cast("string"), F.lit(19)), "[-:]", "")
    return F.concat(F.lit(prefix + "-"), F.replace(digits, F.lit(" "), F.lit("-")), F.lit("-"), F.substring(unique, 1, 8))


def new_id(prefix: str) -> Column:
    return build_id(prefix, F.current_timestamp(), F.uuid())


def id_time(c: Column, prefix: str) -> Column:
    """The time inside an id; null when the id has another form or names no time."""
    stamp = F.regexp_extract(c, rf"\A\Q{prefix}\E-(\d{{8}}-\d{{6}})-[0-9a-f]{{8}}\z", 1)

    def digits(first: int, count: int) -> Column:
        return F.substring(stamp, first, count).try_cast("int")

    day, clock = (digits(1, 4), digits(5, 2), digits(7, 2)), (digits(10, 2), digits(12, 2), digits(14, 2))
    # A leap second is no time that Spark knows; it would be read as the next minute.
    return F.when(clock[2] < 60, F.try_make_timestamp_ntz(*day, *clock))


def id_unique(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"-([0-9a-f]{8})\z", 1), F.lit(""))
