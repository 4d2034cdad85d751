"""Names and word lists that results depend on."""

# -- fixed values: canonical posting columns, in output order ---------------
CANONICAL_COLUMNS = [
    "title", "company", "category", "location", "date_posted", "description_html",
    "description_text", "salary_json_min", "salary_json_max", "salary_json_currency",
    "salary_json_unit", "hiring_remote_in", "workplace_type", "salary_range_short",
    "seniority", "employment_type", "workplace_type_enum", "company_overview", "url", "source",
    "description", "postedDate", "salary", "id", "is_relevant", "tech_stack",
    "min_years_exp", "salary_min", "salary_max", "reason",
]

# -- fixed values: column renames applied on ingest -------------------------
COLUMN_RENAMES = {
    "salary_json_min": "salary_min",
    "salary_json_max": "salary_max",
    "salary_json_currency": "salary_currency",
    "salary_json_unit": "salary_unit",
    "workplace_type_enum": "workplace_type",
    "is_gtm_technical": "is_relevant",
}

# -- fixed values: columns of a ranked result, in output order --------------
RESULT_COLUMNS = [
    "title", "company", "location", "salary", "seniority", "employment_type",
    "workplace_type", "tech_stack", "min_years_exp", "url", "similarity_score",
]

# -- fixed values: columns of a digest record -------------------------------
DIGEST_COLUMNS = [
    "title", "company", "location", "salary", "seniority",
    "workplace_type_enum", "tech_stack", "min_years_exp", "url",
]

# -- fixed values: target column -> candidate raw columns, first filled wins -
LINKEDIN_ALIASES = {
    "url": ["url", "jobUrl", "link"],
    "company": ["company", "companyName"],
    "description_text": ["description_text", "descriptionText", "description", "descriptionHtml"],
    "description_html": ["description_html", "descriptionHtml"],
    "employment_type": ["employment_type", "employmentType", "contractType"],
    "date_posted": ["date_posted", "postedAt", "postedDate"],
    "workplace_type": ["workplace_type", "workplaceType", "workType"],
    "seniority": ["seniorityLevel", "seniority"],
}
BUILTIN_ALIASES = {
    "workplace_type": ["workplace_type", "workType"],
    "description": ["description", "description_text"],
    "postedDate": ["postedDate", "date_posted"],
    "experienceLevel": ["experienceLevel", "seniority"],
    "category_raw": ["category_raw", "category"],
}

# -- fixed values: site seniority wording -> canonical level (None = unknown) -
SENIORITY_LEVELS = {
    "internship": "Intern",
    "entry level": "Junior",
    "associate": "Mid",
    "mid-senior level": "Senior",
    "senior": "Senior",
    "director": "Director",
    "executive": "VP",
    "not applicable": None,
    "": None,
}

# -- fixed values: sources in order of priority -----------------------------
SOURCE_PRIORITY = ["builtin", "linkedin", "serper", "japan_boards"]
DEFAULT_SOURCES = ["builtin", "linkedin", "serper"]

# -- fixed values: locations that belong to the japan boards ----------------
JAPAN_LOCATIONS = ["Japan", "Tokyo", "Japanese companies", "Japan remote"]

# -- fixed values: site lists -----------------------------------------------
ATS_DOMAINS = [
    "boards.greenhouse.io", "jobs.lever.co", "apply.workable.com", "jobs.ashbyhq.com",
    "wellfound.com", "ycombinator.com/jobs", "thehub.io", "topstartups.io",
    "welcometothejungle.com", "eures.europa.eu",
]
JAPAN_BOARDS = ["daijob.com", "gaijinpot.com", "careercross.com", "jp.japanese-jobs.com"]

# -- fixed values: location name -> country codes ---------------------------
EMEA_CODES = ["GBR", "DEU", "NLD", "FRA", "CHE", "SWE", "POL", "CZE"]
COUNTRY_CODES = {
    "czech republic": ["CZE"],
    "cze": ["CZE"],
    "germany": ["DEU"],
    "deu": ["DEU"],
    "netherlands": ["NLD"],
    "poland": ["POL"],
    "austria": ["AUT"],
    "emea": EMEA_CODES,
    "emea wide": EMEA_CODES,
}

# -- fixed values: domain -> signal words, tested in this order -------------
DOMAIN_SIGNALS = {
    "gtm": ["gtm", "revops", "revenue operations", "growth engineer", "sales engineer"],
    "sales": ["account executive", "sales director", "channel", "partner manager",
              "business development", "solutions consultant", "sales manager"],
    "biotech": ["bioinformatics", "computational biology", "genomics", "pharma",
                "life sciences", "clinical", "immunology", "drug discovery"],
    "data": ["data scientist", "ml engineer", "machine learning", "data engineer",
             "analytics engineer", "ai engineer", "llm engineer"],
}

# -- fixed values: domain -> role names that count as relevant --------------
DOMAIN_ROLES = {
    "gtm": ["gtm engineer", "revops engineer", "growth engineer", "sales engineer",
            "solutions engineer"],
    "sales": ["account executive", "sales director", "channel manager", "partner manager",
              "solutions consultant", "business development", "sales engineer"],
    "biotech": ["bioinformatics engineer", "computational biologist", "ml research scientist",
                "data scientist", "genomics engineer"],
    "data": ["data engineer", "ml engineer", "data scientist", "analytics engineer",
             "ai engineer", "llm engineer"],
}

# -- fixed values: keyword taxonomy -----------------------------------------
TAXONOMY = {
    "presales": [
        "pre-sales engineer", "solutions engineer", "solutions consultant", "sales engineer",
        "forward deployed engineer", "applied AI engineer", "technical sales engineer",
    ],
    "tech_based": [
        "AI automation sales", "LLM solutions engineer", "agentic AI sales", "GCP partner sales",
        "PostgreSQL solutions", "data infrastructure sales", "AI consulting presales",
    ],
    "cs_tam": [
        "technical account manager AI", "customer success manager AI SaaS",
        "AI platform customer success", "enterprise customer success data",
        "technical customer success", "renewals account manager SaaS",
    ],
    "fde": [
        "forward deployed engineer AI", "applied AI engineer", "implementation engineer AI SaaS",
        "solutions architect AI", "AI implementation consultant",
    ],
}

# Tools looked for by the rule extractor; callers may pass their own list. Words of plain prose (go, r) are left out.
TECH_VOCABULARY = [
    "airflow", "aws", "azure", "clay", "cuda", "dbt", "docker", "embeddings", "excel", "gcp",
    "golang", "hubspot", "huggingface", "java", "javascript", "kafka", "kubernetes", "llm", "looker",
    "n8n", "node.js", "oracle", "postgresql", "python", "pytorch", "react", "salesforce",
    "snowflake", "spark", "sql", "tableau", "terraform", "typescript",
]
