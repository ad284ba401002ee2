"""Column functions for text, coordinates and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted image extensions, default image, fallback texts.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "gif")
DEFAULT_IMAGE = "/static/default-product.jpg"
UPLOAD_PREFIX = "/static/uploads/"
NO_LOCATION = "Location not specified"
NO_ADDRESS = "Address not found"


def is_blank(column: Column | str) -> Column:
    """NULL or empty text."""
    value = F.col(column) if isinstance(column, str) else column
    return value.isNull() | (value == "")


def latitude(location: Column) -> Column:
    """First part of a 'lat,lon' text; NULL unless both parts are numbers."""
    return _coordinate(location, 0)


def longitude(location: Column) -> Column:
    """Second part of a 'lat,lon' text; NULL unless both parts are numbers."""
    return _coordinate(location, 1)


def _coordinate(location: Column, index: int) -> Column:
    parts = F.split(location, ",")
    numbers = [F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1)]
    return F.when((F.size(parts) == 2) & numbers[1 - index].isNotNull(), numbers[index])


def title_location(location: Column) -> Column:
    """'NATION_0' -> 'Nation 0'; no text -> a fallback."""
    return F.when(is_blank(location), NO_LOCATION).otherwise(F.initcap(F.regexp_replace(location, "[_-]", " ")))


def format_address(response: Column) -> Column:
    """Address lines of a stored geocoder answer (JSON text)."""
    address = F.from_json(
        response,
        "address struct<road string, suburb string, city string, town string, state string, postcode string>",
    )["address"]
    lines = F.concat_ws(
        "\n",
        address["road"],
        address["suburb"],
        F.coalesce(address["city"], address["town"]),
        address["state"],
        F.concat(F.lit("PIN: "), address["postcode"]),
    )
    return F.when(address.isNull(), NO_ADDRESS).otherwise(lines)


def clean_path(path: Column) -> Column:
    """A photo path without surrounding blanks, leading slashes and the static folder."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^\s+|\s+$", ""), "^/+", "")
    return F.replace(bare, F.lit("static/"), F.lit(""))


def image_url(path: Column) -> Column:
    """Public address of an uploaded image, or of the default one."""
    return F.when(is_blank(path), DEFAULT_IMAGE).otherwise(F.concat(F.lit(UPLOAD_PREFIX), path))


def image_extension_ok(file_name: Column) -> Column:
    """Whether the text after the last dot is an accepted image extension."""
    extension = F.lower(F.regexp_extract(file_name, r"\.([^.]*)$", 1))
    return F.coalesce(extension.isin(*IMAGE_EXTENSIONS), F.lit(False))


def date_text(moment: Column) -> Column:
    """'yyyy-MM-dd HH:mm:ss' text of a timestamp."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")
