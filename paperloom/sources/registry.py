"""The eighteen sources: specifications, and the status list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.search import InvalidRequest
from paperloom.sources.base import Source

_GROUPED = ("title", "source_id", "document_url", "collection", "record_group")
_PREVIEWED = (*_GROUPED, "text_preview")
_FULL = ("title", "source_id", "document_url", "collection", "record_group", "description", "text_preview")
# Public addresses, path rules, leads, labels of navigation, categories, groups, collections and cells of
# the sources.
SOURCES = [
    Source("aaro", "https://www.aaro.mil", "AARO UAP Records", "html",
           "(same AND regexp_replace(p, '/', '') <> '') OR regexp_like(u, '^https://([^/]*[.](gov|mil)|(www[.])?dvidshub[.]net)/')", "uap-records", (*_GROUPED, "metadata"), asset_order="images",
           leads="(contains(raw, '/UAP-') AND regexp_like(l, 'uap|case resolution|paper|kona blue|analysis')) OR regexp_like(u, '[.](pdf|jpe?g|png|gif|mp4|mov|wmv)$') OR contains(u, '/portals/136/pdfs/') OR contains(u, 'dvidshub.net/video') OR regexp_like(l, 'pdf|video')",
           category_key="record_category",
           categories=(("case_resolution", "contains(u, '/uap-cases/')"), ("information_papers", "contains(u, 'information') OR contains(u, 'white-paper')"), ("records", "true")),
           groups=(("case_resolution", "contains(u, '/uap-cases/')"), ("information_papers", "contains(u, 'information') OR contains(u, 'white-paper')"), ("records", "true")),
           collections=(("case_resolution", "AARO UAP Case Resolution Reports"), ("information_papers", "AARO Information Papers"))),
    Source("army", "https://foia.army.mil", "Army FOIA Reading Room", "html_table", "same AND (p LIKE '/home%' OR p LIKE '/foia%' OR p LIKE '%.pdf' OR p LIKE '%.zip')", "Home", _FULL, dedupe="document_url",
           navigation=("", "home", "search", "requested records", "foia.gov", "usa.gov"), leads="contains(u, '/home/doccontent/') OR regexp_like(u, '[.](pdf|zip|txt)($|[?])') OR regexp_like(l, '[.](pdf|zip)$')",
           columns=("title", "subject", "keywords", "date", "originator"), file="contains(u, '/home/doccontent/')"),
    Source("cia", "https://www.cia.gov", "CIA Reading Room", "html", "same AND contains(p, '/readingroom/document/')", "readingroom", (), cursor="page"),
    Source("dia", "https://www.dia.mil", "DIA FOIA Reading Room", "html", "same AND (p LIKE '/foia/%' OR p LIKE '/portals/%' OR p LIKE '%.pdf' OR contains(p, '/fileid/'))", "FOIA/FOIA-Electronic-Reading-Room", _PREVIEWED,
           navigation=("", "home", "foia", "search", "clear", "contact us", "privacy"), leads="contains(u, '/foia/foia-electronic-reading-room/') OR contains(u, '/fileid/') OR u LIKE '%.pdf' OR regexp_like(l, 'pdf|report|intelligence')"),
    Source("doe", "https://www.osti.gov", "OpenNet", "html_table", "same AND p LIKE '/opennet/detail%'", "opennet", (), asset_order="plain", cursor="offset",
           columns=("title", "authors", "accession_number", "document_number", "document_type", "originating_research_org", "opennet_entry_date", "date", "declassification_date")),
    Source("doj_epstein", "https://www.justice.gov", "DOJ Epstein Library", "html", "same AND (path LIKE '/epstein%' OR path LIKE '/media/%')", "library-home", ("title", "source_id", "record_group", "description", "metadata"), asset_order="media", lower_label=False,
           leads="""l <> '' AND CASE WHEN l IN ('home', 'search full library', 'doj disclosures', 'house disclosures', 'facebook', 'x', 'linkedin', 'email', 'next', 'last', 'view files') THEN contains(u, '/data-set-')
                  WHEN contains(u, '/epstein/doj-disclosures/') THEN true WHEN contains(u, '/epstein/files/') OR regexp_like(u, '[.](pdf|jpe?g|png|gif|webp|svg|mp4|mov|webm|mp3|wav|m4a)$') OR regexp_like(l, '^efta.*[.]pdf$') THEN true
                  WHEN contains(u, '/media/') THEN regexp_like(l, 'memorandum|press release|letter') ELSE false END""",
           categories=(("efta_data_set", "contains(u, '/data-set-') OR startswith(t, 'data set')"), ("court_record", "contains(u, '/court-records-') OR contains(t, ' v. ')"), ("foia", "contains(u, '/foia-') OR startswith(t, 'foia:')"),
                       ("prior_doj_disclosure", "contains(u, '/bop-video-footage') OR contains(u, '/first-phase-declassified-epstein-files') OR contains(u, '/maxwell-proffer') OR contains(u, '/memoranda-and-correspondence')"), ("release", "true"))),
    Source("doj_foia", "https://www.justice.gov", "DOJ FOIA Libraries", "html", "same OR regexp_like(u, '^https://([^/]*[.])?(justice|usdoj|atf|dea|bop|fbi|usmarshals|ojp)[.]gov/')", "doj-component", _GROUPED, asset_order="others", lower_label=False,
           category_key="disclosure_category",
           categories=(("foia_reading_room", "regexp_like(u, 'readingroom|reading-room|elect-read-room')"), ("foia_library", "regexp_like(u, 'foia-library|foia/library')"), ("proactive_disclosure", "regexp_like(u, 'available-documents|foia')"), ("component_disclosure", "true"))),
    Source("dtic", "https://apps.dtic.mil", "DTIC Technical Reports", "html_table", "same AND (p LIKE '/sti/citations/%' OR p LIKE '/sti/html/%' OR p LIKE '/sti/pdfs/%')", "sti", (), asset_order="plain"),
    Source("fbi_vault", "https://vault.fbi.gov", "FBI Vault", "html", "same AND regexp_replace(p, '/', '') <> ''", "vault-home", _GROUPED, asset_order="images",
           categories=(("proactive_disclosure", "contains(u, 'proactive-disclosure')"), ("discretionary_release", "contains(u, 'discretionary')"), ("all_files", "contains(u, 'all-files')"), ("vault_file", "true"))),
    Source("frus", "https://history.state.gov", "Foreign Relations of the United States", "html", "same AND regexp_like(p, '^/historicaldocuments/[^/]+/d[0-9]+$')", "historicaldocuments", (), asset_order="transcripts"),
    Source("govinfo", "https://www.govinfo.gov", "GovInfo", "json", "u LIKE 'https://api.govinfo.gov/packages/%' OR u LIKE 'https://www.govinfo.gov/%'", "app", (), cursor="mark"),
    Source("nara", "https://catalog.archives.gov", "National Archives Catalog", "json", "u LIKE 'https://catalog.archives.gov/%' OR u LIKE 'https://s3.amazonaws.com/%'", "catalog", (), cursor="offset"),
    Source("navy", "https://www.secnav.navy.mil", "Department of the Navy FOIA Reading Room", "html_table", "same AND (p LIKE '/foia%' OR p LIKE '/ig%' OR p LIKE '/navaudsvc%')", "foia/readingroom", _FULL,
           navigation=("", "home", "search", "submit a foia request", "foia request", "reading room"), leads="regexp_like(u, '/foia/readingroom/|/foia reading room/|/navaudsvc/|/ig/') OR regexp_like(l, 'foia|reading room|pdf')",
           groups=(("naval_audit_service", "contains(u, '/navaudsvc/')"), ("naval_inspector_general", "contains(u, '/ig/')"), ("department_of_the_navy_foia_reading_room", "true")),
           collections=(("naval_audit_service", "Naval Audit Service FOIA Reading Room"), ("naval_inspector_general", "Naval Inspector General FOIA Reading Room")),
           columns=("title", "topic", "date", "office"), file="regexp_like(u, '[.](pdf|zip|txt|docx?|xlsx?)($|[?])')"),
    Source("noaa", "https://repository.library.noaa.gov", "NOAA Institutional Repository", "html", "same AND regexp_like(p, '^/view/noaa/[a-z0-9-]+')", "view", ("title", "source_id", "document_url", "description", "collection", "record_group", "metadata"), dedupe="merge", asset_order="plain"),
    Source("nsa", "https://www.nsa.gov", "NSA FOIA Reading Room", "html", "same AND (startswith(path, '/Helpful-Links/NSA-FOIA/') OR startswith(path, '/Portals/75/documents/') OR startswith(path, '/portals/75/documents/'))", "Helpful-Links/NSA-FOIA/Reading-Room", _GROUPED, asset_order="images",
           navigation=("", "learn more", "enter the room", "search info", "browse documents"),
           leads="regexp_like(u, '/helpful-links/nsa-foia/reading-room/|/foia-reports-and-releases/|/portals/75/documents/') OR contains(l, 'foia') OR contains(l, 'pdf')",
           categories=(("foia_reports_and_releases", "regexp_like(u, '/foia-reports-and-releases/|/declassified-documents/')"), ("reading_room_policy", "contains(u, '/foia-handbook') OR contains(u, 'policy')"), ("reading_room", "true")),
           groups=(("foia_reports_and_releases", "regexp_like(u, '/foia-reports-and-releases/|/declassified-documents/')"), ("reading_room_policy", "contains(u, '/foia-handbook') OR contains(u, 'policy')"), ("reading_room", "true")),
           collections=(("foia_reports_and_releases", "NSA FOIA Reports and Releases"), ("reading_room_policy", "NSA FOIA Reading Room Policy Records"))),
    Source("osd_joint_staff", "https://www.esd.whs.mil", "OSD and Joint Staff Reading Room", "html", "same AND (p LIKE '/foid/%' OR p LIKE '/foia/%' OR p LIKE '/records-declass/foia/reading-room/%' OR p LIKE '/portals/%' OR p LIKE '%.pdf' OR contains(p, '/reading%20room/'))", "Records-Declass/FOIA/Reading-Room", _PREVIEWED,
           navigation=("", "home", "foia", "search", "clear", "contact us", "privacy", "foia.gov", "usa.gov"),
           leads="contains(u, '/records-declass/foia/reading-room/reading-room-list_2/') OR contains(u, '/foid/reading-room/') OR contains(u, '/portals/54/documents/foid/reading') OR u LIKE '%.pdf' OR regexp_like(l, 'pdf|joint staff|reading room|report|strategy')"),
    Source("pursue", "https://www.war.gov", "PURSUE Releases", "csv", "true", "ufo", ("title", "source_id", "description", "date", "metadata"), asset_order="recordings", lower_label=False),
    Source("state", "https://foia.state.gov", "State FOIA Virtual Reading Room", "html", "same AND (p LIKE '/search/%' OR p LIKE '/foialibrary/%' OR p LIKE '/documents/%' OR p LIKE '/docs/%' OR p LIKE '%.pdf')", "Search/Results.aspx", _PREVIEWED,
           navigation=("", "foia home", "making a foia request", "foia library", "records management", "mandatory declassification review", "about us/contact us", "site map", "privacy & disclaimers", "foia.gov", "state.gov", "contact", "search released documents"),
           leads="regexp_like(u, '/search/|/foialibrary/|/documents/|/docs/') OR regexp_like(l, 'case|pdf|document')"),
]
BY_NAME = {s.name: s for s in SOURCES}


def source_named(name: str) -> Source:
    if name not in BY_NAME:
        raise InvalidRequest(f"unknown source {name!r}; known are {', '.join(BY_NAME)}")
    return BY_NAME[name]


def source_status(spark: SparkSession, enabled: dict[str, bool] | None = None) -> DataFrame:
    """name, collection, kind, status (enabled, or available where no adapter is set up), in registry order."""
    rows = [(i, s.name, s.collection, s.kind) for i, s in enumerate(SOURCES)]
    registry = spark.createDataFrame(rows, "ord int, name string, collection string, kind string")
    live = spark.createDataFrame(sorted((enabled or {}).items()), "name string, on boolean")
    joined = registry.join(live, "name", "left")
    return joined.select("ord", "name", "collection", "kind", F.when(F.col("on"), F.lit("enabled")).otherwise(F.lit("available")).alias("status")).orderBy("ord").drop("ord")
