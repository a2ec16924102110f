"""Schemas of the catalogue tables and of the published documents."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}


def flat(columns: str) -> T.StructType:
    """A schema from "name type, ..."; needs no session, unlike Spark's own parser."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(","))])


TABLES: dict[str, T.StructType] = {
    name: flat(columns)
    for name, columns in {
        "events": "id string, simulation int, priority_factors string, preferred_name string, ra_deg double, dec_deg double, coordinate_error_arcsec double, "
        "discovery_time string, first_detection_time string, discovery_survey string, discovery_instrument string, discovery_magnitude double, status string, "
        "host_name string, host_redshift double, transient_redshift double, distance_mpc double, consensus_class string, consensus_probability double, "
        "priority_score double, event_type string, primary_messenger string, updated_at string",
        "aliases": "event_id string, provider string, external_id string",
        "classification_assertions": "id long, event_id string, provider string, classification string, subtype string, probability double, method string, "
        "asserted_at string, citation_url string, data_rights string, superseded int, retracted int",
        "observations": "id long, event_id string, provider string, observed_at string, detection int, telescope string, observatory string, instrument string, "
        "pipeline string, band string, magnitude_system string, magnitude double, magnitude_error double, flux double, flux_error double, flux_unit string, "
        "limiting_magnitude double, exposure_seconds double, signal_to_noise double, calibration string, photometry_method string, summary string, "
        "source_url string, data_rights string, superseded int",
        "messenger_signals": "id long, event_id string, provider string, provider_signal_id string, observed_at string, messenger string, role string, "
        "instrument string, detection int, alert_type string, significance_sigma double, false_alarm_rate_hz double, sky_area_50_sq_deg double, "
        "sky_area_90_sq_deg double, distance_mpc double, distance_std_mpc double, measurement string, summary string, source_url string, skymap_url string, "
        "data_rights string, simulation int",
        "spectra": "id long, event_id string, provider string, provider_spectrum_id string, observed_at string, telescope string, instrument string, "
        "configuration string, wavelength_unit string, flux_unit string, resolution double, calibration_state string, public_download_url string, "
        "file_name string, file_checksum string, source_url string, data_rights string",
        "publications": "id long, provider string, provider_publication_id string, publication_type string, canonical_url string, published_at string, data_rights string",
        "publication_revisions": "id long, publication_id long, retrieved_at string, title string, authors_text string, abstract string",
        "publication_event_links": "event_id string, publication_id long",
        "sources": "id string, display_name string, facility string, data_types string, mode string, public_scope string, runtime_state string, "
        "runtime_detail string, last_message_at string, lag_seconds double, documentation_url string, enabled int",
    }.items()
}
