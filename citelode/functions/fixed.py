"""Fixed values that results depend on."""

#: Title openings of notices.
NOTICE_WORDS = ("retraction", "retracted", "withdrawal", "withdrawn", "erratum", "corrigendum")
#: Keys of names that stand for no name.
PLACEHOLDERS = (
    "unknown", "unavailable", "not available", "not applicable", "not reported", "not provided", "not specified",
    "none", "null", "n/a", "na",
    "affiliation unknown", "affiliations unknown", "affliation unknown", "affiliation not provided to ssrn",
    "no affiliation available", "no affiliations available", "no affiliation given", "no affiliation found",
)
#: Roles whose works count as originals.
ORIGINAL_ROLES = ("original_supported", "unresolved")
#: Observation windows in years; 0 is the lifetime.
WINDOWS = (("3y", 3), ("5y", 5), ("10y", 10), ("lifetime", 0))
#: Words shown to readers for the names of populations and fields; a name counts where no letter, digit or _ touches it.
READABLE = {"core_article": "research articles", "core_all": "all works", "primary_topic": "main topic", "root_publisher": "publishing group", "common_5y": "common five-year cohort"}
