"""DOIs, dataset numbers and the links built from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeharbor.functions.core import as_column, non_empty, strip
from citeharbor.functions.patterns import ARCHIVE_KEYWORD

# Link prefixes and identifier patterns.
DOI_RESOLVER = "https://doi.org/"
STUDY_PAGE = "https://www.icpsr.umich.edu/web/ICPSR/studies/"
RESOLVER_PREFIX = r"(?i)^https?://(?:dx\.)?doi\.org/"
ANY_DOI = r"(?iu)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
DATA_DOCUMENT_DOI = r"(?U)^10\.3886/(icpsr|e)\d+"
DATA_VENUES = (ARCHIVE_KEYWORD, "openicpsr")

# Work categories.
UNRELATED = "not_icpsr_related"
DATA_DOCUMENT = "icpsr_data_doc"
RESEARCH = "research_article_using_icpsr"


def clean_doi(doi: Column | str) -> Column:
    """Trim and drop a resolver prefix, keeping the case of the rest."""
    return F.regexp_replace(strip(doi), RESOLVER_PREFIX, "")


def find_doi(text: Column | str) -> Column:
    """First DOI anywhere in the text, NULL when there is none."""
    return non_empty(F.regexp_extract(as_column(text), ANY_DOI.replace(r"\d", r"\p{Nd}"), 0))


def _decimal(value: Column | str) -> Column:
    return strip(as_column(value).cast("string")).try_cast("decimal(38,6)")


def to_number(value: Column | str) -> Column:
    """Numeric value of a string or number; anything unparsable is NULL."""
    return _decimal(value).cast("double")


def study_key(value: Column | str) -> Column:
    """Dataset number as BIGINT, so that 08079, 8079 and 8079.0 are one dataset."""
    number = _decimal(value)
    return F.when(number % 1 == 0, number.try_cast("bigint"))


def study_link(value: Column | str) -> Column:
    """Landing page of a dataset; empty when the number is missing."""
    key = study_key(value)
    return F.when(key.isNotNull(), F.concat(F.lit(STUDY_PAGE), key.cast("string"))).otherwise("")


def doi_link(doi: Column | str) -> Column:
    """Clickable form: blank stays blank, a URL stays as it is, else the resolver is added."""
    text = strip(doi)
    return (F.when(text.isNull() | (text == ""), "")
            .when(text.startswith("http"), text)
            .otherwise(F.concat(F.lit(DOI_RESOLVER), text)))


def is_data_document(doi: Column | str, venue: Column | str, strict_prefix: bool = False) -> Column:
    """True for documents issued by the archive itself, by DOI or by venue.

    A resolver prefix is removed before the DOI test; ``strict_prefix=True``
    tests the stored value as it is.
    """
    bare = as_column(doi) if strict_prefix else clean_doi(doi)
    venue = F.lower(as_column(venue))
    by_venue = F.lit(False)
    for name in DATA_VENUES:
        by_venue = by_venue | F.coalesce(venue.contains(name), F.lit(False))
    return F.coalesce(F.lower(bare).rlike(DATA_DOCUMENT_DOI), F.lit(False)) | by_venue


def work_category(text_hit: Column | str, reference_hit: Column | str, doi: Column | str,
                  venue: Column | str, strict_prefix: bool = False,
                  docs_first: bool = False, mapped_work: Column | None = None) -> Column:
    """Category of a work from its evidence and its origin.

    Works without evidence are unrelated. With ``docs_first`` the archive's own
    documents (also those whose id is a mapped dataset) are labelled first,
    evidence or not.
    """
    evidence = (F.coalesce(as_column(text_hit), F.lit(False))
                | F.coalesce(as_column(reference_hit), F.lit(False)))
    document = is_data_document(doi, venue, strict_prefix)
    if docs_first:
        if mapped_work is not None:
            document = document | F.coalesce(mapped_work, F.lit(False))
        return (F.when(document, DATA_DOCUMENT)
                .when(evidence, RESEARCH).otherwise(UNRELATED))
    return (F.when(~evidence, UNRELATED)
            .when(document, DATA_DOCUMENT).otherwise(RESEARCH))
