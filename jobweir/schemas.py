"""Schemas of tables, postings and payloads."""

from __future__ import annotations

#: Platforms that apply URLs are classified into (fixed values).
KINDS = (
    "greenhouse", "ashbyhq", "lever", "workable", "smartrecruiters", "bamboohr", "recruitee",
    "personio", "breezy", "teamtailor", "pinpoint", "jazzhr", "workday", "comeet", "other",
)

COMPANIES = (
    "id bigint, name string, ats_kind string, ats_slug string, website string, "
    "first_seen timestamp, last_seen timestamp"
)
DISCOVERIES = "company_id bigint, discovered_via string, discovered_at timestamp, source_url string"
JOBS = (
    "id bigint, company_id bigint, ats_kind string, external_id string, title string, "
    "location string, remote boolean, department string, apply_url string, description string, "
    "posted_at string, first_seen timestamp, last_seen timestamp, closed_at timestamp, "
    "raw_json string, status string, status_changed_at timestamp, status_note string"
)
RUNS = (
    "source string, started_at timestamp, finished_at timestamp, ok boolean, http_status int, "
    "items_seen bigint, items_new bigint, error string"
)
META = "key string, value string"

#: What must not be null, by table.
REQUIRED = {
    "companies": ["id", "name", "ats_kind", "ats_slug", "first_seen", "last_seen"],
    "company_discoveries": ["company_id", "discovered_via", "discovered_at"],
    "jobs": [
        "id", "company_id", "ats_kind", "external_id", "title", "apply_url", "first_seen",
        "last_seen", "raw_json", "status",
    ],
    "crawl_runs": ["source", "started_at"],
}

#: A normalised posting: what every adapter returns beside (kind, slug).
POSTING = (
    "external_id string, title string, location string, department string, apply_url string, "
    "description string, remote boolean, posted_at string, raw_json string"
)
POSTING_COLUMNS = [x.split()[0] for x in POSTING.split(", ")]

#: One landed response of a company's posting list.
LANDED = "kind string, slug string, fetched_at timestamp, http_status int, page_offset int, body string"

#: An entry of each platform's list, with the path of the list in the body.
ENTRIES = {
    "greenhouse": (
        "jobs",
        "id string, title string, absolute_url string, location struct<name:string>, "
        "offices array<struct<name:string,location:string>>, departments array<struct<name:string>>, "
        "content string, updated_at string",
    ),
    "ashbyhq": (
        "jobs",
        "id string, title string, locationName string, departmentName string, jobUrl string, "
        "publishedAt string, isRemote boolean, descriptionPlain string",
    ),
    "lever": (
        None,
        "id string, text string, categories struct<location:string,team:string>, hostedUrl string, "
        "createdAt bigint, descriptionPlain string, workplaceType string",
    ),
    "smartrecruiters": (
        "content",
        "id string, name string, location struct<fullLocation:string,remote:boolean>, "
        "department struct<label:string>, releasedDate string",
    ),
    "bamboohr": (
        "result",
        "id string, jobOpeningName string, departmentLabel string, employmentStatusLabel string, "
        "location struct<city:string,state:string>, isRemote boolean, locationType string",
    ),
    "recruitee": (
        "offers",
        "id string, title string, location string, department string, careers_url string, "
        "description string, requirements string, remote boolean, published_at string",
    ),
    "workday": (
        "jobPostings",
        "title string, externalPath string, locationsText string, postedOn string, "
        "bulletFields array<string>",
    ),
}
FEED = (
    "url string, title string, description string, company_name string, category_name string, "
    "tags string, location string, pub_date string"
)
