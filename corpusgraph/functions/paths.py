"""Path expressions. All are plain columns, so scans can be filtered by them."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph import constants as K
from corpusgraph.functions.exprs import let, strings


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased last extension with its dot, or an empty string."""
    return F.regexp_extract(F.lower(path), r"[^/](\.[^./]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(
        "(project root)"
    )


def depth(path: Column) -> Column:
    """Directory depth below the root; a file in the root has depth 0."""
    return F.size(F.split(path, "/")) - 1


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def in_ignored_directory(path: Column, extra: list[str] | None = None) -> Column:
    names = strings(K.IGNORED_DIRECTORIES + list(extra or []))
    return F.arrays_overlap(directories(path), names)


def has_hidden_segment(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def is_vendor_file(path: Column) -> Column:
    return base_name(path).rlike(K.VENDOR_SUFFIX)


def has_extension(path: Column, extensions: list[str]) -> Column:
    return extension(path).isin(*extensions)


def is_asset(path: Column) -> Column:
    return has_extension(path, K.ASSET_EXTENSIONS)


def literal_extension(text: Column) -> Column:
    """Extension of a string literal after its query or fragment is cut off."""
    bare = F.get(F.split(text, r"[?#]"), F.lit(0))
    return F.regexp_extract(F.lower(bare), r"^.+?(\.[^.]*)$", 1)


def is_asset_literal(text: Column) -> Column:
    bare = F.lower(F.get(F.split(text, r"[?#]"), F.lit(0)))
    last = F.concat(F.lit("."), F.substring_index(bare, ".", -1))
    return (F.instr(bare, ".") > 0) & (F.length(last) < F.length(bare)) & last.isin(
        *K.ASSET_LITERAL_EXTENSIONS
    )


def posix(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def relative_id(absolute: Column, root: Column) -> Column:
    """Project-relative, forward-slash id of an absolute path."""
    path, base = posix(absolute), posix(root)
    inside = path.startswith(F.concat(base, F.lit("/")))
    return F.when(inside, F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def strip_resource_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^res://", "")


def asset_reference(raw: Column) -> Column:
    """Forward slashes, no empty, ``.`` or ``..`` segments; NULL when nothing is left."""
    kept = F.filter(F.split(posix(raw), "/"), lambda s: ~s.isin("", ".", ".."))
    return F.nullif(F.array_join(kept, "/"), F.lit(""))


def patch_path(raw: Column) -> Column:
    """Like :func:`asset_reference`, but one ``..`` refuses the whole path."""
    parts = F.split(F.trim(F.regexp_replace(posix(raw), "^/+", "")), "/")
    kept = F.filter(parts, lambda s: ~s.isin("", "."))
    return F.when(
        ~F.array_contains(parts, ".."), F.nullif(F.array_join(kept, "/"), F.lit(""))
    )


def containment(raw: Column) -> Column:
    """``struct(refusal, relative_path)``; refusal is NULL for a contained path."""
    clean = F.trim(posix(raw))
    parts = F.split(clean, "/")
    kept = F.array_join(F.filter(parts, lambda s: ~s.isin("", ".")), "/")
    refusal = (
        F.when(raw.contains("\0"), "null_byte")
        .when(clean == "", "empty_path")
        .when(raw.startswith("/") | clean.startswith("//") | clean.rlike("^[A-Za-z]:/"),
              "absolute_path")
        .when(F.array_contains(parts, ".."), "traversal")
        .when(kept == "", "empty_path")
    )
    return F.struct(
        refusal.alias("refusal"), F.when(refusal.isNull(), kept).alias("relative_path")
    )


def fold_segments(path: Column) -> Column:
    """Fold ``.`` and ``..``; NULL when the path climbs above its root."""
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin("", "."), acc)
        .when((s == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1))
        .when(s != "..", F.concat(acc, F.array(s))),
    )
    return F.array_join(folded, "/")


def parent_folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def is_external_specifier(specifier: Column) -> Column:
    """Bare and scheme-like module names never resolve to a project file."""
    return ~(specifier.startswith(".") | specifier.startswith("/"))


def resolve_relative(from_path: Column, reference: Column) -> Column:
    """Project-relative target of a reference; a leading ``/`` means the root."""
    base = F.when(reference.startswith("/"), reference).otherwise(
        F.concat(parent_folder(from_path), F.lit("/"), reference)
    )
    return F.nullif(fold_segments(base), F.lit(""))


def resolve_page_link(page_path: Column, link: Column) -> Column:
    """Local target of a page link; anything with a scheme or host is NULL."""
    clean = F.trim(link)
    foreign = (clean == "") | clean.startswith("//") | clean.rlike(r"^(?i)[a-z][a-z0-9+.\-]*:")
    return F.when(~foreign, resolve_relative(page_path, clean))


def exact_or_typed(base: Column) -> Column:
    """The path itself, and for a JavaScript extension its typed twins."""
    script = r"\.(js|mjs|cjs|jsx)$"
    typed = F.when(
        base.rlike(script),
        F.transform(
            strings(K.TYPED_TWINS), lambda e: F.concat(F.regexp_replace(base, script, ""), e)
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(base), typed)


def candidate_paths(base: Column) -> Column:
    """``array<struct(priority, candidate)>`` of files a specifier may mean."""
    probes = F.concat(
        F.transform(strings(K.PROBED_EXTENSIONS), lambda e: F.concat(base, e)),
        F.transform(strings(K.PROBED_EXTENSIONS), lambda e: F.concat(base, F.lit("/index"), e)),
    )
    names = F.when(base.rlike(r"\.[A-Za-z0-9]+$"), exact_or_typed(base)).otherwise(probes)
    return F.transform(names, lambda n, i: F.struct(i.alias("priority"), n.alias("candidate")))


def satisfied_bases(path: Column) -> Column:
    """``array<struct(base, priority)>``: the specifier bases that an existing file answers.

    The other side of :func:`candidate_paths`: a base asks for up to fourteen files,
    but a file answers a handful of bases, and there are fewer files than references.
    """
    dotted = r"\.[A-Za-z0-9]+$"
    suffix = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    root = F.substring(path, F.lit(1), F.length(path) - F.length(suffix))
    probe = F.array_position(strings(K.PROBED_EXTENSIONS), suffix) - 1
    twin = F.array_position(strings(K.TYPED_TWINS), suffix)

    def pair(base: Column, priority: Column) -> Column:
        return F.struct(base.alias("base"), priority.cast("int").alias("priority"))

    own = F.array(pair(path, F.lit(0)))
    scripts = F.when(twin > 0, F.transform(strings([".js", ".mjs", ".cjs", ".jsx"]), lambda e: pair(F.concat(root, e), twin)))
    bare = F.when((probe >= 0) & ~root.rlike(dotted), F.array(pair(root, probe)))
    home = parent_folder(path)
    index = F.when((probe >= 0) & (base_name(root) == "index") & (home != "") & ~home.rlike(dotted),
                   F.array(pair(home, probe + len(K.PROBED_EXTENSIONS))))
    parts = F.filter(F.array(own, scripts, bare, index), lambda p: p.isNotNull())
    return F.flatten(parts)


def language(path: Column) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(".js", ".mjs", ".cjs", ".jsx"), "javascript")
        .when(ext.isin(".ts", ".mts", ".cts"), "typescript")
        .when(ext == ".tsx", "tsx")
        .when(ext == ".gd", "gdscript")
    )


def normalize_project_key(path: Column) -> Column:
    """Trim, drop one pair of surrounding quotes, forward slashes."""
    return let(
        F.trim(path),
        lambda p: posix(
            F.when(p.rlike("^(?s)(\".*\"|'.*')$") & (F.length(p) >= 2),
                   F.trim(F.substring(p, F.lit(2), F.length(p) - 2))).otherwise(p)
        ),
    )
