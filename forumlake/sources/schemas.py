"""Schemas of the entities, as DDL. All columns are nullable."""

MEMBER = "STRUCT<name STRING, id STRING, party STRING, role STRING, extra STRING>"
MEETINGS = f"title STRING, location STRING, Sitzung STRING, Gremium STRING, Gremien STRING, Datum STRING, Zeit STRING, source_url STRING, extra MAP<STRING,STRING>, saved_at STRING, attendance ARRAY<{MEMBER}>, attendence ARRAY<{MEMBER}>"
TOPS = "top_id STRING, meeting_id STRING, name STRING, public BOOLEAN, type STRING, antrag_party ARRAY<STRING>, aktenzeichen STRING, vorlage_id STRING, vorlage_url STRING, beschluss STRUCT<beratungsergebnis_1 STRING, beraturngsergebnis_1 STRING, beratungsergebnis_2 STRING, beraturngsergebnis_2 STRING, stimmenverteilung STRING>, files ARRAY<STRUCT<url STRING, label STRING, id STRING, type STRING>>, saved_at STRING"
PERSONS = "person_id STRING, anrede STRING, vorname STRING, nachname STRING, partei STRUCT<handle STRING, typ STRING, url STRING>, href STRING, data MAP<STRING, ARRAY<STRING>>, ende STRING, `beginn ende` STRING"
VORLAGEN = "vorlage_id STRING, typ STRING, betreff STRING, aktenzeichen STRING, url STRING, datum_added STRING, docs ARRAY<STRUCT<title STRING, dtype STRING, url STRING>>, meetings ARRAY<STRUCT<datum STRING, intent STRING, gremium STRING, title STRING, ergebnis STRING, stimmen STRING, dateien ARRAY<STRUCT<title STRING, href STRING>>>>"
LLM_RUNS = "run_id STRING, model STRING, created_at STRING, prompt_version STRING, system_prompt STRING, user_input STRING, input_hash STRING, params MAP<STRING,DOUBLE>, output_text STRING, output_json VARIANT, latency_ms BIGINT, input_tokens BIGINT, output_tokens BIGINT, error STRING, meta STRUCT<meeting_date STRING, top_id STRING>"
MANIFEST = "file STRING, url STRING, retrieval_date STRING"
PDF_WORDS = "doc STRING, page INT, ord INT, text STRING, x0 DOUBLE, x1 DOUBLE, top DOUBLE, bottom DOUBLE"
PDF_RULES = "doc STRING, page INT, y INT"
