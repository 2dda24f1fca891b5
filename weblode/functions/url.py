"""URL algebra as column expressions.

Every function accepts any string: splitting is by the generic URI pattern, never by a strict URL
parser that rejects spaces or odd escapes.  Nothing here leaves the JVM, so the expressions stay in
the scan stage.  Dot-segment removal and query re-encoding use higher-order functions and sit behind
a ``CASE`` that only the few URLs needing them pass.

Names with a leading underscore take and return SQL text; the public functions work on columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.functions.binding import apply, bind, quoted
from weblode.lookups import HTML_EXTENSIONS, SKIP_URL_PATTERN, TRACKING_PARAMS

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
# Only hierarchical schemes have ";parameters".
_WITH_PARAMS = rf"(?i)^(?:(?:https?|ftp|sftp|rtspu?|sips?|mms|tel|shttp|hdl|prospero):|(?!{_SCHEME}:))"
# Rooted references without dot segments, parameters, query or fragment: resolved by gluing.
# Possessive repetition, so a path of any length is matched in a loop.
_SIMPLE_ROOTED = r"^/(?:[^/.?#;\s\[\]][^/?#;\s\[\]]*+/)*+(?:[^/.?#;\s\[\]][^/?#;\s\[\]]*+)?$"

# Lower-case authority, no query, fragment, parameters or trailing slash: nothing to normalise.
_OWN_KEY = r"^https?://[a-z0-9.:\-]+(?:/[^?#;\s]*[^/?#;\s])?$"


# --- parts ------------------------------------------------------------------------------------


def _tidy(url: str) -> str:
    """Drop leading control characters and spaces, and tabs or line breaks anywhere."""
    return rf"regexp_replace({url}, r'^[\x00-\x20]+|[\t\r\n]', '')"


def _scheme(url: str) -> str:
    return f"lower(regexp_extract({url}, r'^({_SCHEME}):', 1))"


def _netloc(url: str) -> str:
    """Authority as written: user info, host and port."""
    return f"regexp_extract({url}, r'^(?:{_SCHEME}:)?//([^/?#]*)', 1)"


def _raw_path(url: str) -> str:
    return f"regexp_extract({url}, r'^(?:{_SCHEME}:)?(?://[^/?#]*)?([^?#]*)', 1)"


def _without_params(raw_path: str) -> str:
    # They belong to the last segment only.
    return f"regexp_replace({raw_path}, r';[^/]*$', '')"


def _query(url: str) -> str:
    return rf"regexp_extract({url}, r'^[^?#]*\?([^#]*)', 1)"


def _split(url: str) -> str:
    """``struct(scheme, netloc, path, params, query)``; ``params`` keeps its ``;``, empty marks are dropped."""

    def parts(u: str) -> str:
        return bind(
            f"named_struct('raw', {_raw_path(u)}, 'has', {u} RLIKE r'{_WITH_PARAMS}')",
            lambda p: (
                f"named_struct('scheme', {_scheme(u)}, 'netloc', {_netloc(u)}, "
                f"'path', CASE WHEN {p}.has THEN {_without_params(f'{p}.raw')} ELSE {p}.raw END, "
                f"'params', CASE WHEN {p}.has THEN regexp_extract({p}.raw, r'(;[^/]+)$', 1) ELSE '' END, "
                f"'query', {_query(u)})"
            ),
        )

    return bind(_tidy(url), parts)


def _domain(url: str) -> str:
    return f"lower({_netloc(_tidy(url))})"


def _strip_www(domain: str) -> str:
    return rf"regexp_replace(lower({domain}), r'^www\.', '')"


def _hostname(url: str) -> str:
    return bind(
        f"regexp_replace({_netloc(url)}, r'^.*@', '')",
        lambda a: (
            rf"lower(CASE WHEN startswith({a}, '[') THEN regexp_extract({a}, r'^\[([^\]]*)\]', 1) "
            rf"ELSE regexp_extract({a}, r'^([^:]*)', 1) END)"
        ),
    )


# --- joining and resolving ----------------------------------------------------------------------


def _rooted(path: str) -> str:
    return f"CASE WHEN startswith({path}, '/') OR {path} = '' THEN {path} ELSE concat('/', {path}) END"


def _join(scheme: str, netloc: str, path: str, params: str, query: str) -> str:
    """Put parts back together; a path is rooted only when there is an authority.

    All arguments are read several times: pass names or fields.
    """
    return (
        f"concat(CASE WHEN {scheme} <> '' THEN concat({scheme}, ':') ELSE '' END, "
        f"CASE WHEN {netloc} <> '' OR startswith({path}, '//') OR ({scheme} IN ('http', 'https', 'ftp') "
        f"AND ({path} = '' OR startswith({path}, '/'))) THEN concat('//', {netloc}) ELSE '' END, "
        f"CASE WHEN {netloc} <> '' THEN {_rooted(path)} ELSE {path} END, {params}, "
        f"CASE WHEN {query} <> '' THEN concat('?', {query}) ELSE '' END)"
    )


def _respell(p: str) -> str:
    return _join(f"{p}.scheme", f"{p}.netloc", f"{p}.path", f"{p}.params", f"{p}.query")


def _drop_fragment(url: str) -> str:
    return f"CASE WHEN contains({url}, '#') THEN {bind(_split(url), _respell)} ELSE {url} END"


def _clean_path(path: str) -> str:
    """Remove ``.`` and ``..`` segments; going above the root stays at the root."""
    walk = (
        f"aggregate(split({path}, '/'), cast(array() AS array<string>), (acc, seg) -> "
        "CASE WHEN seg = '..' THEN slice(acc, 1, greatest(size(acc) - 1, 0)) WHEN seg = '.' THEN acc "
        "ELSE concat(acc, array(seg)) END)"
    )
    closing = rf"CASE WHEN {path} RLIKE r'(^|/)\.\.?$' THEN array('') ELSE cast(array() AS array<string>) END"
    return (
        rf"CASE WHEN {path} RLIKE r'(^|/)\.\.?(/|$)' THEN array_join(concat({walk}, {closing}), '/') ELSE {path} END"
    )


def _resolve(ref: str, base: str, raw: str) -> str:
    """Resolve reference parts against base parts; ``raw`` is the reference as written."""

    def under_base(path: str) -> str:
        return bind(
            f"CASE WHEN {path} = '' THEN '/' ELSE {path} END",
            lambda p: _join(f"{base}.scheme", f"{base}.netloc", p, f"{ref}.params", f"{ref}.query"),
        )

    # A relative path replaces the last segment of the base path; runs of slashes collapse.
    merged = (
        f"regexp_replace(concat('/', regexp_replace({base}.path, r'[^/]*$', ''), {ref}.path), r'/{{2,}}', '/')"
    )
    inherited = bind(
        f"CASE WHEN {ref}.query <> '' THEN {ref}.query ELSE {base}.query END",
        lambda q: _join(f"{base}.scheme", f"{base}.netloc", f"{base}.path", f"{base}.params", q),
    )
    target = (
        f"CASE WHEN {ref}.scheme <> '' AND {ref}.scheme <> {base}.scheme THEN {_drop_fragment(raw)} "
        f"WHEN {ref}.netloc <> '' THEN {_join(f'{base}.scheme', f'{ref}.netloc', f'{ref}.path', f'{ref}.params', f'{ref}.query')} "
        f"WHEN {ref}.path = '' AND {ref}.params = '' THEN {inherited} "
        f"WHEN startswith({ref}.path, '/') THEN {bind(_clean_path(f'{ref}.path'), under_base)} "
        f"ELSE {bind(merged, lambda m: bind(_clean_path(m), under_base))} END"
    )
    # Unbalanced brackets make an address no client can request.
    authority = f"CASE WHEN {ref}.netloc <> '' THEN {ref}.netloc ELSE {base}.netloc END"
    return bind(authority, lambda a: f"CASE WHEN contains({a}, '[') = contains({a}, ']') THEN {target} END")


def _against(reference: str, base: str) -> str:
    return (
        f"CASE WHEN {reference} RLIKE r'{_SIMPLE_ROOTED}' AND NOT contains({base}.netloc, '[') "
        f"THEN concat({base}.scheme, '://', {base}.netloc, {reference}) "
        f"ELSE {bind(_split(reference), lambda ref: _resolve(ref, base, reference))} END"
    )


def _with_scheme(url: str) -> str:
    return bind(url, lambda u: f"CASE WHEN {u} RLIKE '^https?://' THEN {u} ELSE concat('https://', {u}) END")


# --- crawl key --------------------------------------------------------------------------------


def _unquote(text: str) -> str:
    """Percent-decode, leaving malformed escapes and ``+`` as they are."""
    guarded = f"regexp_replace(replace({text}, '+', '%2B'), r'%(?![0-9A-Fa-f]{{2}})', '%25')"
    return f"CASE WHEN contains({text}, '%') THEN url_decode({guarded}) ELSE {text} END"


def _quote_plus(text: str) -> str:
    encoded = f"replace(replace(url_encode({text}), '*', '%2A'), '%7E', '~')"
    return rf"CASE WHEN {text} RLIKE r'[^A-Za-z0-9_.~\-]' THEN {encoded} ELSE {text} END"


def _clean_query(query: str) -> str:
    """Drop tracking parameters and re-encode the rest, values grouped by key in first-seen order."""
    name = bind("replace(substring_index(part, '=', 1), '+', ' ')", _unquote)
    value = bind("replace(regexp_replace(part, r'^[^=]*=?', ''), '+', ' ')", _unquote)
    pairs = f"transform(filter(split({query}, '&'), part -> part <> ''), part -> named_struct('k', {name}, 'v', {value}))"
    kept = f"filter({pairs}, pair -> lower(pair.k) NOT IN {quoted(TRACKING_PARAMS)})"

    def rebuild(kv: str) -> str:
        keys = f"array_distinct(transform({kv}, pair -> pair.k))"
        grouped = f"flatten(transform({keys}, key -> filter({kv}, pair -> pair.k = key)))"
        return f"array_join(transform({grouped}, pair -> concat({_quote_plus('pair.k')}, '=', {_quote_plus('pair.v')})), '&')"

    return f"CASE WHEN {query} = '' THEN '' ELSE {bind(kept, rebuild)} END"


def _crawl_key(url: str) -> str:
    def spell(p: str) -> str:
        parts = (
            f"named_struct('netloc', lower({p}.netloc), 'query', {_clean_query(f'{p}.query')}, "
            f"'path', CASE WHEN {p}.path = '/' THEN '/' ELSE regexp_replace({p}.path, r'/+$', '') END)"
        )
        return bind(parts, lambda c: _join(f"{p}.scheme", f"{c}.netloc", f"{c}.path", f"{p}.params", f"{c}.query"))

    # Most addresses are their own key already; the pattern proves it.
    return f"CASE WHEN {url} RLIKE r'{_OWN_KEY}' THEN {url} ELSE {bind(_split(url), spell)} END"


# --- names ------------------------------------------------------------------------------------


def _filename(url: str) -> str:
    return bind(
        f"substring_index({_without_params(_raw_path(_tidy(url)))}, '/', -1)",
        lambda s: f"CASE WHEN {s} = '' THEN 'unknown' ELSE {_unquote(s)} END",
    )


def _extension(filename: str) -> str:
    ext = f"regexp_replace(concat('.', lower(substring_index({filename}, '.', -1))), r'[^a-z0-9.]', '')"
    return f"CASE WHEN contains({filename}, '.') THEN {ext} ELSE '' END"


# --- on columns -------------------------------------------------------------------------------


def tidy(url: Column) -> Column:
    """Without leading control characters and spaces, and without tabs or line breaks."""
    return apply(_tidy, url)


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, rf"^({_SCHEME}):", 1))


def netloc_of(url: Column) -> Column:
    """Authority part as written: user info, host and port."""
    return F.regexp_extract(url, rf"^(?:{_SCHEME}:)?//([^/?#]*)", 1)


def split_url(url: Column) -> Column:
    """``struct(scheme, netloc, path, params, query)``."""
    return apply(_split, url)


def domain_of(url: Column) -> Column:
    """Lower-cased authority, port and user info included."""
    return apply(_domain, url)


def site_of(url: Column) -> Column:
    """Lower-cased authority without one leading ``www.``: equal sites are "internal" to each other."""
    return apply(lambda u: _strip_www(_domain(u)), url)


def strip_www(domain: Column) -> Column:
    return apply(_strip_www, domain)


def same_site(left: Column, right: Column) -> Column:
    return F.coalesce(site_of(left) == site_of(right), F.lit(False))


def hostname_of(url: Column) -> Column:
    """Host alone, lower-cased: no user info, no port."""
    return apply(_hostname, url)


def resolve_against(reference: Column, base: Column) -> Column:
    """Resolve ``reference`` against the parts of an absolute URL (see :func:`split_url`), dropping the fragment.

    Null when the authority has an unbalanced IPv6 bracket.
    """
    return apply(lambda b: _against(f"{b}.ref", f"{b}.base"), F.struct(reference.alias("ref"), base.alias("base")))


def resolve_url(reference: Column, base: Column) -> Column:
    """:func:`resolve_against` for a base given as text; an empty reference is the base as written."""
    whole = apply(_drop_fragment, base)
    return F.when(reference == "", whole).otherwise(resolve_against(reference, split_url(base)))


def with_scheme(url: Column) -> Column:
    return apply(_with_scheme, url)


def normalize_url(url: Column, base: Column | None = None) -> Column:
    """Absolute form of a link: resolved, without fragment, with a scheme."""
    if base is None:
        return apply(lambda u: _with_scheme(_drop_fragment(u)), url)
    return with_scheme(resolve_url(url, base))


def crawl_key(url: Column) -> Column:
    """Identity of a page while crawling: tracking parameters, host case, trailing slashes and fragment removed.

    Scheme, ``www.`` and an empty versus ``/`` root stay distinct.
    """
    return apply(_crawl_key, url)


def filename_of(url: Column) -> Column:
    """Last path segment, percent-decoded; ``unknown`` for a directory."""
    return apply(_filename, url)


def extension_of_name(filename: Column) -> Column:
    """``.pdf``-style extension, or empty.  A trailing dot gives ``.``."""
    return apply(_extension, filename)


def extension_of(url: Column) -> Column:
    return apply(lambda u: bind(_filename(u), _extension), url)


def is_page_extension(extension: Column) -> Column:
    return apply(lambda e: f"{e} = '' OR {e} IN {quoted(HTML_EXTENSIONS)}", extension)


def is_skipped(url: Column) -> Column:
    """Comment-reply and feed URLs, never crawled."""
    return url.rlike(SKIP_URL_PATTERN)


def is_valid_url(url: Column) -> Column:
    return F.coalesce(
        apply(lambda u: bind(_tidy(u), lambda t: f"{_scheme(t)} IN ('http', 'https') AND {_netloc(t)} <> ''"), url),
        F.lit(False),
    )


def display_url(url: Column, max_length: int = 50) -> Column:
    """Short form for reports: the URL, ``host/.../file``, or a cut with an ellipsis."""

    def shorten(u: str) -> str:
        return bind(
            f"concat({_netloc(_tidy(u))}, '/.../', {_filename(u)})",
            lambda s: (
                f"CASE WHEN length({u}) <= {max_length} THEN {u} WHEN length({s}) <= {max_length} THEN {s} "
                f"ELSE concat(substring({u}, 1, {max_length - 3}), '...') END"
            ),
        )

    return apply(shorten, url)


def display_host_path(url: Column, max_length: int) -> Column:
    """Host and path, cut with an ellipsis; URLs without a host are cut as they are."""

    def shown(t: str) -> str:
        path = bind(_raw_path(t), lambda p: f"CASE WHEN {p} = '' THEN '/' ELSE {p} END")
        return f"concat({_hostname(t)}, {path})"

    def cut(text: str) -> str:
        return (
            f"CASE WHEN length({text}) > {max_length} THEN concat(substring({text}, 1, {max_length - 3}), '...') "
            f"ELSE {text} END"
        )

    def choose(u: str) -> str:
        return bind(
            f"CASE WHEN {_scheme(_tidy(u))} IN ('http', 'https') AND {_netloc(_tidy(u))} <> '' "
            f"THEN {bind(_tidy(u), shown)} ELSE {u} END",
            cut,
        )

    return apply(choose, url)
