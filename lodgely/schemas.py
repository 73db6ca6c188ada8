"""Schemas of the layers, as DDL; every business value is a string until silver."""

LISTING = "title string, price string, area string, location string, url string"
RAW_PAGE = "request_url string, final_url string, status_code int, html string, headers map<string,string>, fetch_strategy string, fetched_at string, elapsed_ms double"
TARGET = "url string, source string, target_type string, page_number int, parent_url string, listing_id string, discovered_at string"
REQUEST_LOG = (
    "run_id string, source string, target_type string, request_url string, final_url string, page_number int, fetch_strategy string, http_status int, content_type string, server string, "
    "cf_ray string, html_size bigint, started_at string, finished_at string, elapsed_ms double, retry_count int, robots_allowed boolean, crawl_status string"
)
CARD = (
    "source string, listing_id string, detail_url string, title_raw string, price_raw string, area_raw string, location_raw string, posted_at_raw string, seller_name_raw string, "
    "seller_type_raw string, thumbnail_url_raw string, card_position int, page_number int"
)
DETAIL = (
    "source string, listing_id string, detail_url string, title_raw string, price_raw string, area_raw string, address_raw string, location_raw string, description_raw string, "
    "posted_at_raw string, updated_at_raw string, property_type_raw string, furnishing_raw string, deposit_raw string, seller_name_raw string, seller_type_raw string, "
    "image_urls_raw array<string>, amenities_raw array<string>"
)
BRONZE = (
    "listing_id string, source string, url string, title_raw string, price_raw string, area_raw string, address_raw string, location_raw string, description_raw string, posted_at_raw string, "
    "property_type_raw string, furnishing_raw string, deposit_raw string, seller_name_raw string, seller_type_raw string, image_urls_raw array<string>, amenities_raw array<string>, "
    "crawl_run_id string, crawled_at string"
)
MANIFEST = (
    "run_id string, source string, started_at string, finished_at string, pages_success int, pages_failed int, details_success int, details_failed int, records_created int, "
    "duplicates_skipped int, errors array<string>"
)
