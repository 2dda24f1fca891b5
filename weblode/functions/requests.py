"""Validation of scan requests and download targets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weblode.functions.binding import let
from weblode.functions.sizes import format_size
from weblode.functions.text import strip
from weblode.functions.url import hostname_of, tidy, with_scheme

_EMPTY = "Please enter a website address"
_NO_HOST = "Please enter a valid website address (e.g. example.com)"
_NO_DOT = "That doesn't look like a complete website address. Did you mean "
_SPACES = "The website address contains spaces. Please check for typos and try again"
_ENDING = (
    "The website address doesn't have a valid ending (like .com or .org). Please check the address and try again"
)


def check_url(url: Column) -> Column:
    """``struct(url, error)``: the address with a scheme, or the first rule it breaks."""

    def judge(address: Column) -> Column:
        full = with_scheme(address)
        return let(
            F.struct(full.alias("url"), hostname_of(tidy(full)).alias("host")),
            lambda x: F.struct(
                x["url"].alias("url"),
                F.when(address == "", F.lit(_EMPTY))
                .when(x["host"] == "", F.lit(_NO_HOST))
                .when(
                    ~F.contains(x["host"], F.lit(".")) & (x["host"] != "localhost"),
                    F.concat(F.lit(_NO_DOT), x["host"], F.lit(".com?")),
                )
                .when(F.contains(x["url"], F.lit(" ")), F.lit(_SPACES))
                .when(
                    F.contains(x["host"], F.lit("."))
                    & (F.length(F.substring_index(x["host"], ".", -1)) < 2),
                    F.lit(_ENDING),
                )
                .alias("error"),
            ),
        )

    return let(let(strip(url), judge), lambda r: F.struct(F.when(r["error"].isNull(), r["url"]).alias("url"), r["error"].alias("error")))


def check_depth(depth: Column, max_allowed: Column) -> Column:
    """Error text for a crawl depth out of range, or null."""
    return F.when(depth < 1, F.lit("max_depth must be >= 1")).when(
        depth > max_allowed, F.concat(F.lit("max_depth must be <= "), max_allowed.cast("string"))
    )


def check_path(exists: Column, is_dir: Column, writable: Column, path: Column, free: Column, required: Column) -> Column:
    """``struct(valid, code, message)`` of a download target from what the file system reports.

    ``writable`` is the folder's own flag, or that of its nearest existing parent.
    """
    short = (required > 0) & (free < required)
    code = (
        F.when(F.coalesce(path, F.lit("")) == "", F.lit("empty"))
        .when(exists & ~is_dir, F.lit("not_directory"))
        .when(~writable, F.lit("not_writable"))
        .when(short, F.lit("insufficient_space"))
        .when(~exists, F.lit("not_exists"))
    )
    message = (
        F.when(code == "empty", F.lit("Download path cannot be empty"))
        .when(code == "not_directory", F.lit("Path exists but is not a directory"))
        .when(code == "not_writable", F.lit("Directory exists but is not writable"))
        .when(
            code == "insufficient_space",
            F.concat(
                F.lit("Not enough disk space. Need "), format_size(required), F.lit(", only "), format_size(free),
                F.lit(" available"),
            ),
        )
        .when(code == "not_exists", F.lit("Directory will be created"))
        .otherwise(F.lit("Directory exists and is writable"))
    )
    valid = code.isNull() | (code == "not_exists")
    return F.struct(valid.alias("valid"), code.alias("code"), message.alias("message"))
