"""Explicit schemas of the inputs. Nothing is inferred from data."""

from __future__ import annotations

RECAP_DOCUMENT = (
    "struct<id:bigint,docket_entry_id:bigint,document_number:int,entry_date_filed:string,"
    "description:string,document_type:string,is_available:boolean,absolute_url:string>"
)
HIT = (
    "struct<docket_id:bigint,caseName:string,docketNumber:string,court:string,court_id:string,"
    "dateFiled:string,dateTerminated:string,cause:string,suitNature:string,"
    f"docket_absolute_url:string,recap_documents:array<{RECAP_DOCUMENT}>>"
)
HIT_PAGE = f"count bigint, next string, previous string, results array<{HIT}>"

FILING = (
    "document_id string, docket_entry_id string, document_number int, entry_date_filed string, "
    "description string, document_type string, available_in_recap boolean, url string"
)
DOCKET = (
    "docket_id bigint, case_name string, docket_number string, docket_url string, court string, "
    "court_id string, date_filed date, date_terminated date, termination_state string, active boolean, "
    "active_status_caveat string, cause string, suit_nature string, first_seen_at string, "
    "last_seen_at string, last_changed_at string, freshness string, filings_digest string"
)
DOCKET_FILING = f"docket_id bigint, {FILING}"

CHANGES = "array<struct<field:string,before:string,after:string>>"

FINDER_CASE = (
    "id string, company string, title string, kind string, window_status string, freshness string, "
    "deadline timestamp, proof string, aliases array<string>, issue_types array<string>, "
    "situations array<string>, eligible_states array<string>, covered_start string, covered_end string, "
    "notice_required boolean, has_criteria boolean, recognition_label string"
)

PROFILE = (
    "user_id string, full_name string, contact_email string, phone string, address_line1 string, "
    "address_line2 string, city string, region string, postal_code string, country_code string"
)
CLAIM = (
    "claim_id string, user_id string, case_id string, case_title_snapshot string, company_snapshot string, "
    "personal_status string, status_provenance string, confirmation_number string, submitted_at timestamp, "
    "approved_at timestamp, approved_amount_cents bigint, paid_at timestamp, received_amount_cents bigint, "
    "amount_source string, private_note string, created_at timestamp, updated_at timestamp"
)
