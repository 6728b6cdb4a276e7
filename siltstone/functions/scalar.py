"""Scalar functions as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes, in hexadecimal, by which a stored object's codec is told.
ZSTD_MAGIC, BROTLI_MAGIC, ZLIB_HEAD = "28B52FFD", "42525401", "78"


def shard_path(oid: Column) -> Column:
    """objects/aa/bb/key."""
    return F.concat_ws("/", F.lit("objects"), F.substring(oid, 1, 2), F.substring(oid, 3, 2), oid)


def chunk_sizes(size: Column) -> Column:
    """struct(average, least, most) in bytes of the chunks of a file of that size."""
    mb, gb = 1 << 20, 1 << 30
    of = lambda a, b, c: F.struct(F.lit(a).cast("long").alias("average"), F.lit(b).cast("long").alias("least"), F.lit(c).cast("long").alias("most"))
    return F.when(size <= 100 * mb, of(mb, mb // 2, 4 * mb)).when(size <= 10 * gb, of(2 * mb, mb, 8 * mb)).when(size <= 100 * gb, of(4 * mb, mb, 16 * mb)).otherwise(of(8 * mb, mb, 32 * mb))


def codec(data: Column) -> Column:
    """zstd, brotli, zlib or store, by the leading bytes; a zlib head's two bytes are a multiple of 31."""
    head = F.hex(F.substring(data, 1, 4))
    two = F.conv(F.hex(F.substring(data, 1, 2)), 16, 10).cast("int")
    zlib = (F.octet_length(data) >= 2) & head.startswith(ZLIB_HEAD) & (two % 31 == 0)
    return F.when(head == ZSTD_MAGIC, "zstd").when(head == BROTLI_MAGIC, "brotli").when(zlib, "zlib").otherwise("store")


def hamming_similarity(a: Column, b: Column, bits: int = 64) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(bits)


def valid_ref_name(name: Column) -> Column:
    """Not empty; none of the characters that file systems refuse; no dot or slash at an end, no two of either together, no
    `@{`, and not the name of a lock."""
    return (F.length(name) > 0) & ~name.rlike(r'[\\:?*"<>|\x00]|\A[./]|[./]\z|\.\.|//|\.lock\z|@\{')


def ref_namespace(name: Column) -> Column:
    return F.when(name == "HEAD", "head").when(name.startswith("refs/heads/"), "branch").when(name.startswith("refs/tags/"), "tag").when(name.startswith("refs/remotes/"), "remote").otherwise("other")


def re_escape(text: str) -> str:
    return re.escape(text)


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: * and ? within a part, ** across parts, [ab], [a-z] and [!a] one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed [ in {glob}")
            inner = glob[i + 1 : end]
            no, inner = ("^", inner[1:]) if inner[0] in "!^" else ("", inner)
            out, i = out + f"[{no}" + re.sub(r"([\\\[\]^&])", r"\\\1", inner) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def matches_glob(name: Column, glob: str) -> Column:
    """Whether a name matches; a pattern that isn't one keeps all."""
    try:
        return name.rlike(glob_regex(glob))
    except ValueError:
        return F.lit(True)


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules hold for a path: the last matching rule decides, `!` takes a path back unless a directory above
    it is ignored, a slash before the end ties a rule to the root, a trailing slash means directories only."""
    parents = F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda k: F.concat_ws("/", F.slice(F.split(path, "/"), F.lit(1), k))), lambda x: x != path)

    def verdict(x: Column, is_dir: bool) -> Column:
        out = F.lit(False)
        for rule in rules:
            body = rule.lstrip("!").rstrip("/")
            if not body or rule.startswith("#") or (rule.endswith("/") and not is_dir):
                continue
            glob = body.lstrip("/") if "/" in body else f"**/{body}"
            out = F.when(x.rlike(glob_regex(glob)), F.lit(not rule.startswith("!"))).otherwise(out)
        return out

    return F.exists(parents, lambda x: verdict(x, True)) | verdict(path, False)


def pointer(version: str, oid: Column, size: Column) -> Column:
    """The text of a pointer file: version, oid and size, a line each."""
    return F.concat(F.lit(f"version {version}\noid sha256:"), oid, F.lit("\nsize "), size.cast("string"), F.lit("\n"))


def parse_pointer(text: Column, most: int = 512) -> Column:
    """struct(oid, size) of a pointer file, null for other content. Lines come in any order, blank ones count as none; of a
    repeated one the last holds. A pointer is short, so longer content isn't looked at."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r"))), lambda x: x != "")
    good = F.forall(lines, lambda x: x.rlike(r"\A(version .+|oid sha256:[0-9a-fA-F]{64}|size \+?[0-9]+)\z"))
    value = lambda key: F.regexp_replace(F.element_at(F.filter(lines, lambda x: x.startswith(key)), -1), f"^{key}", "")
    has = F.forall(F.array(*map(F.lit, ("version ", "oid ", "size "))), lambda k: F.exists(lines, lambda x: F.startswith(x, k)))
    made = F.struct(value("oid sha256:").alias("oid"), value("size ").try_cast("long").alias("size"))
    return F.when((F.octet_length(text) <= most) & good & has, made)


def reflog_line(old: Column, new: Column, name: Column, email: Column, seconds: Column, message: Column) -> Column:
    """`old new name <email> seconds +0000`, a tab and the message, whose line ends become spaces."""
    return F.concat(old, F.lit(" "), new, F.lit(" "), name, F.lit(" <"), email, F.lit("> "), seconds.cast("string"), F.lit(" +0000\t"), F.regexp_replace(message, r"[\r\n]+", " "))


def parse_reflog(line: Column) -> Column:
    """struct(old, new, name, email, seconds, message); null for a line of another shape."""
    shape = r"^(\S+) (\S+) (.*) <([^>]*)> (\d+) [+-]\d{4}\t(.*)$"
    part = lambda k: F.regexp_extract(line, shape, k)
    return F.when(line.rlike(shape), F.struct(part(1).alias("old"), part(2).alias("new"), part(3).alias("name"), part(4).alias("email"), part(5).try_cast("long").alias("seconds"), part(6).alias("message")))


def human_bytes(n: Column) -> Column:
    """KB, MB or GB of 1,024s with two decimals; plain `n bytes` below."""
    out = F.format_string("%d bytes", n.cast("long"))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.2f {unit}", F.bround(n / float(1024**k), 2))).otherwise(out)
    return out


def time_ago(seconds: Column) -> Column:
    """`n units ago` of an age in seconds, in seconds, minutes, hours or days; units stay plural."""
    out = F.concat(seconds.cast("long").cast("string"), F.lit(" seconds ago"))
    for size, unit in ((60, "minutes"), (3600, "hours"), (86400, "days")):
        out = F.when(seconds >= size, F.concat(F.floor(seconds / size).cast("string"), F.lit(f" {unit} ago"))).otherwise(out)
    return out


#: The first bytes of file types, in hexadecimal; a container's form stands at its ninth byte.
MAGIC = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "gif": "47494638", "psd": "38425053", "pdf": "25504446", "zip": "504B0304", "gzip": "1F8B", "zstd": "28B52FFD", "matroska": "1A45DFA3", "flac": "664C6143", "ogg": "4F676753", "glb": "676C5446", "bmp": "424D"}
FORMS = {"webp": "57454250", "wav": "57415645", "avi": "41564920"}


def magic_type(data: Column, looked_at: int = 512) -> Column:
    """The type by leading bytes; RIFF by its form, ISO media by `ftyp`; else text if what is looked at is UTF-8 without
    zero bytes, or binary. A character cut at the end of what is looked at counts as whole."""
    head = F.hex(F.substring(data, 1, 12))
    out = None
    for kind, hexa in MAGIC.items():
        out = F.when(head.startswith(hexa), kind) if out is None else out.when(head.startswith(hexa), kind)
    for kind, hexa in FORMS.items():
        out = out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == hexa), kind)
    out = out.when(F.substring(head, 9, 8) == "66747970", "mp4")
    first = F.substring(data, 1, looked_at)
    begun = {1: "(C[2-9A-F]|D.|E.|F[0-4])", 2: "(E.|F[0-4])[89AB].", 3: "F[0-4]([89AB].){2}"}  # bytes of a character that isn't whole
    cut = lambda k: F.hex(F.substring(data, looked_at - k + 1, k)).rlike(f"^{begun[k]}$") & F.is_valid_utf8(F.substring(data, 1, looked_at - k))
    valid = reduce(or_, [F.is_valid_utf8(first), *((F.octet_length(data) > looked_at) & cut(k) for k in begun)])
    zero = F.instr(F.decode(first, "ISO-8859-1"), "\0") > 0
    return out.when(valid & ~zero, "text").otherwise("binary")


def valid_ref(target: Column, symbolic: Column) -> Column:
    """A ref has a target or points to another ref, not both."""
    return target.isNotNull() != symbolic.isNotNull()


def full_ref(name: Column) -> Column:
    """The name in full: HEAD and full names as they are, others as branches."""
    return F.when((name == "HEAD") | name.startswith("refs/"), name).otherwise(F.concat(F.lit("refs/heads/"), name))


def safe_path(path: Column) -> Column:
    """No absolute path, no drive, no zero byte and no way up."""
    return (F.length(path) > 0) & ~path.rlike(r"^[/\\]|^[A-Za-z]:|\x00|(^|[/\\])\.\.([/\\]|$)")
