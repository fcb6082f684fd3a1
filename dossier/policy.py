"""Policy as data: weights, bands, labels, patterns, templates and rule words.

Every operator takes its policy as a parameter with one of these as default.
"""
from __future__ import annotations

# ---- fixed values: roles, states and limits -------------------------------------
SEES_ALL = ("admin", "auditor")
CASE_STATES = ("active", "under_review", "closed", "archived")
OPEN_STATES = ("active", "under_review")
CLASSIFICATIONS = ("internal", "confidential", "restricted")
DOCUMENT_KINDS = ("fir", "police_report", "witness_statement", "charge_sheet", "court_filing", "evidence",
                  "forensic_report", "legal_notice", "judgment", "other")
DECISIONS = ("approved", "changes_requested", "rejected")
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
MAX_DOCX_XML_BYTES = 3_000_000
LOCK_AFTER_FAILURES = 5
LOCK_MINUTES = 15
SESSION_HOURS = 12
GENESIS = "0" * 64
FIRST_CASE_NUMBER = 1001
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
REFERENCE_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9/._-]*$"

# ---- fixed values: accepted files -------------------------------------------------
MIME_BY_EXTENSION = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".txt": "text/plain",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
MAGIC_BY_EXTENSION = {
    ".pdf": "255044462D",
    ".png": "89504E470D0A1A0A",
    ".jpg": "FFD8FF",
    ".jpeg": "FFD8FF",
    ".docx": "504B0304",
}
SCREENING_MIMES = {
    ".jpg": ("image/jpeg", "image/jpg", "image/pjpeg", "application/octet-stream"),
    ".jpeg": ("image/jpeg", "image/jpg", "image/pjpeg", "application/octet-stream"),
    ".png": ("image/png", "image/x-png", "application/octet-stream"),
    ".pdf": ("application/pdf", "application/x-pdf", "application/acrobat", "applications/vnd.pdf",
             "text/pdf", "application/octet-stream"),
}

# ---- fixed values: fields of identity documents -------------------------------------
FIELD_LABELS = {
    "full_name": "Name",
    "date_of_birth": "Date of Birth",
    "document_number": "Document Number",
    "gender": "Gender",
    "nationality": "Nationality",
    "issue_date": "Date of Issue",
    "expiry_date": "Date of Expiry",
    "address": "Address",
    "father_name": "Father's / Guardian's Name",
    "pincode": "Postal / PIN Code",
    "facial_photo": "Facial Photo",
}
CONFLICT_SEVERITY = {
    "full_name": "high",
    "date_of_birth": "high",
    "document_number": "high",
    "facial_photo": "high",
    "father_name": "high",
    "address": "medium",
    "gender": "medium",
    "nationality": "medium",
    "pincode": "medium",
}
NAME_FIELDS = ("full_name", "father_name")
DATE_FIELDS = ("date_of_birth", "issue_date", "expiry_date")
TYPE_SCOPED_FIELDS = ("document_number", "issue_date", "expiry_date")
FUSED_FIELDS = ("full_name", "date_of_birth", "document_number", "address", "gender")
MANDATORY_FIELDS = {
    "passport": ("full_name", "date_of_birth", "document_number", "nationality", "expiry_date"),
    "national_id": ("full_name", "date_of_birth", "document_number"),
    "pan": ("full_name", "date_of_birth", "document_number"),
    "aadhaar": ("full_name", "date_of_birth", "document_number"),
    "driving_licence": ("full_name", "date_of_birth", "document_number"),
    "voter_id": ("full_name", "document_number"),
    "visa": ("full_name", "document_number"),
    "address_proof": ("full_name",),
}
NUMBER_PATTERNS = {
    "passport": r"^[A-Z]{1,2}[0-9]{7,8}$",
    "national_id": r"^[A-Z]{2}-[0-9]{4}-[0-9]{4}$",
    "pan": r"^[A-Z]{5}[0-9]{4}[A-Z]$",
    "aadhaar": r"^[2-9][0-9]{3}\s?[0-9]{4}\s?[0-9]{4}$",
    "driving_licence": r"^[A-Z]{2}[-\s]?[0-9]{2}[-\s]?[0-9]{4}[-\s]?[0-9]{7}$|^[A-Z]{2}[0-9]{13,15}$",
    "voter_id": r"^[A-Z]{3}[0-9]{7}$",
}
NON_PERSON_PAN = ("C", "H", "F", "A", "T", "B", "L", "J", "G")
AGE_BOUND_TYPES = ("driving_licence", "voter_id")

# ---- fixed values: risk weights (weight, cap; no cap = None), reductions and bands ----
RISK_WEIGHTS = {
    "dob_mismatch": (30, None),
    "name_mismatch": (30, None),
    "document_number_mismatch": (25, None),
    "address_mismatch": (15, None),
    "gender_nationality_mismatch": (15, None),
    "face_mismatch": (35, None),
    "face_borderline": (15, None),
    "forensic_high": (25, 1),
    "forensic_medium": (12, 2),
    "validation_fail_per_check": (6, 18),
    "expired_document": (10, 1),
    "mrz_checksum_fail": (20, 1),
    "document_reuse": (30, 1),
}
RISK_REDUCTIONS = {
    "name_consistent": -5,
    "address_consistent": -5,
    "face_matched": -5,
    "mrz_valid": -5,
    "all_validations_pass": -5,
}
RISK_BANDS = (
    (29, "LOW", "verification_passed"),
    (59, "MEDIUM", "review_recommended"),
    (79, "HIGH", "manual_review_required"),
    (100, "CRITICAL", "manual_review_required"),
)
UNABLE = "unable_to_verify"
CONFLICT_FACTOR = {
    "date_of_birth": "dob_mismatch",
    "full_name": "name_mismatch",
    "document_number": "document_number_mismatch",
    "address": "address_mismatch",
    "gender": "gender_nationality_mismatch",
    "nationality": "gender_nationality_mismatch",
    "facial_photo": "face_mismatch",
    "father_name": "name_mismatch",
    "pincode": "address_mismatch",
    "RULE-AGE-001": "dob_mismatch",
    "RULE-CHRONO-001": "document_number_mismatch",
    "RULE-PAN-001": "name_mismatch",
    "RULE-FATHER-001": "name_mismatch",
}

# ---- fixed values: outcome sets -------------------------------------------------------
VALID_OUTCOMES = ("verification_passed", "low_risk")
DASHBOARD_REVIEW = ("review_recommended", "manual_review_required", "unable_to_verify")
KPI_REVIEW = ("review_recommended", "unable_to_verify")
HIGH_RISK_OUTCOMES = ("manual_review_required", "high_risk")
HIGH_RISK_SCORE = 60
OUTCOME_FILTERS = {
    "valid": ("verification_passed",),
    "review": ("review_recommended",),
    "high_risk": ("manual_review_required",),
    "unable": ("unable_to_verify",),
}
RISK_TIERS = (
    (20, "Low Risk", "0 – 20"),
    (49, "Moderate", "21 – 49"),
    (74, "Elevated", "50 – 74"),
    (None, "Critical", "75 – 100"),
)
RANGE_DAYS = {"7d": 7, "30d": 30, "90d": 90, "all": 180}

# ---- fixed values: labels of the analytics page -----------------------------------------
ANALYTICS_FIELD_LABELS = {
    "date_of_birth": "Date of Birth (DOB)",
    "full_name": "Full Legal Name",
    "facial_photo": "Facial Biometrics",
    "document_number": "Document / ID Number",
    "address": "Residential Address",
    "gender": "Gender / Sex",
    "nationality": "Nationality",
    "expiry_date": "Expiration Date",
    "issue_date": "Issue Date",
    "father_name": "Father's / Guardian Name",
}
RANKED_FIELDS = ("date_of_birth", "full_name", "facial_photo", "document_number", "address", "gender",
                 "nationality")
ANALYTICS_TYPE_LABELS = {
    "passport": "Passport (ICAO TD3)",
    "national_id": "National Identity Card",
    "pan": "PAN Card (Income Tax)",
    "driving_licence": "Driving Licence",
    "voter_id": "Voter ID / Electoral Card",
    "address_proof": "Utility / Address Proof",
    "certificate": "Official Certificate",
    "other": "Other Supporting Document",
}
LISTED_TYPES = ("passport", "national_id", "pan", "driving_licence", "address_proof")
STAGE_LABELS = {
    "preprocess": "Image Preprocessing",
    "ocr": "Multi-pass OCR Extraction",
    "classify": "Document Classification",
    "fields": "Field & Entity Parsing",
    "qrcode": "QR / Barcode Cross-check",
    "forensics": "Tampering & ELA Forensics",
    "mrz_validation": "MRZ & Checksum Validation",
    "faces": "Facial Biometric Matching",
    "consistency": "Cross-document Consistency",
    "risk": "Explainable Risk Engine",
}
SIGNALS = {
    "copy_move_cloning": ("Copy-Move / Stamp Cloning", "tampering"),
    "ela_compression_anomaly": ("Error Level Analysis (ELA)", "tampering"),
    "facial_photo_mismatch": ("Facial Biometric Discrepancy", "biometric"),
    "qr_barcode_conflict": ("QR Payload Discrepancy", "validation"),
    "mrz_checksum_error": ("MRZ Check Digit Inconsistency", "security_feature"),
    "noise_gradient_anomaly": ("Noise Residual & Font Splicing", "tampering"),
}
OCR_BOUND_STAGES = ("classify", "fields", "qrcode", "validate", "consistency")
DOCUMENT_LABELS = {
    "aadhaar": "Aadhaar Card",
    "pan": "PAN Card",
    "driving_licence": "Driving Licence",
    "passport": "Passport",
    "voter_id": "Voter ID (EPIC)",
    "national_id": "National ID",
    "visa": "Visa",
    "address_proof": "Address Proof",
    "certificate": "Certificate",
    "unknown": "Unknown / Unclassified",
    "other": "Other Identity Document",
}

# ---- fixed values: text templates: keyword weights, patterns, aspect range ------------------
PATTERN_BOOST = 4.5
LEAST_CONFIDENCE = 0.22
TEMPLATES = {
    "aadhaar": {
        "keywords": {
            "aadhaar": 8.0, "uidai": 7.0, "mera aadhaar": 5.0, "unique identification": 5.0,
            "government of india": 3.0, "enrolment": 3.0, "enrolment no": 4.0, "vid": 3.0,
            "help@uidai.gov.in": 4.0, "1947": 2.0, "my aadhaar": 3.5, "year of birth": 2.5,
            "father:": 2.0, "husband:": 2.0,
        },
        "patterns": (r"\b[2-9]\d{3}\s\d{4}\s\d{4}\b", r"\b\d{4}\s\d{4}\s\d{4}\s\d{4}\b"),
        "aspect": (1.35, 1.85),
    },
    "pan": {
        "keywords": {
            "permanent account number": 8.0, "income tax": 5.0, "pan": 3.0, "cardholder": 2.0,
            "father's name": 2.5, "income tax department": 5.0, "govt. of india": 3.0,
        },
        "patterns": (r"\b[A-Za-z]{5}[0-9]{4}[A-Za-z]\b",),
        "aspect": (1.4, 2.0),
    },
    "driving_licence": {
        "keywords": {
            "driving licence": 7.5, "driving license": 7.5, "driver license": 7.5, "dl no": 4.0,
            "licence to drive": 4.0, "authorised to drive": 3.5, "transport department": 4.0,
            "union of india": 3.0, "blood group": 2.0, "valid till": 2.0, "motor vehicle": 3.0,
        },
        "patterns": (r"\b[A-Za-z]{2}[-\s]?\d{2}[-\s]?\d{4}[-\s]?\d{7}\b",),
        "aspect": (1.3, 2.0),
    },
    "passport": {
        "keywords": {
            "passport": 7.0, "republic of india": 4.0, "surname": 3.0, "given name": 3.0,
            "nationality": 2.5, "date of expiry": 2.0, "p<": 5.0, "type p": 3.0,
        },
        "patterns": (r"\bP<[A-Za-z]{3}", r"\b[A-Za-z][0-9]{7,8}\b"),
        "aspect": (1.2, 1.8),
    },
    "voter_id": {
        "keywords": {
            "election commission": 7.5, "electoral photo identity card": 7.0, "identity card": 4.0,
            "epic": 6.0, "elector": 4.5, "elector's name": 4.5, "voter": 4.0,
            "assembly constituency": 4.0, "parliamentary constituency": 4.0, "epic no": 5.0, "part no": 3.0,
        },
        "patterns": (r"\b[A-Za-z]{3}[0-9]{7}\b",),
        "aspect": (1.3, 1.8),
    },
    "visa": {
        "keywords": {"visa": 6.0, "entries": 2.0, "duration of stay": 2.0, "valid until": 2.0, "v<": 3.5},
        "patterns": (),
        "aspect": None,
    },
    "national_id": {
        "keywords": {"national id": 6.0, "identity card": 4.0, "id no": 2.5, "id number": 2.5,
                     "citizen": 2.0, "uid": 1.5},
        "patterns": (),
        "aspect": (1.3, 2.0),
    },
    "address_proof": {
        "keywords": {"address proof": 6.0, "residing at": 3.0, "utility": 2.5, "electricity": 2.5,
                     "bill": 2.0, "consumer no": 2.0},
        "patterns": (),
        "aspect": None,
    },
    "certificate": {
        "keywords": {"certificate": 6.0, "degree": 2.5, "awarded": 2.0, "institute": 2.0,
                     "university": 2.0, "has successfully completed": 3.0},
        "patterns": (),
        "aspect": None,
    },
}

# ---- fixed values: labels that introduce a printed field (field, labels, kind, multi-line) ----
LABEL_SPECS = (
    ("date_of_birth", ("date of birth", "dob", "birth date"), "date", False),
    ("surname_part", ("surname", "last name"), "name", False),
    ("given_names_part", ("given name", "first name"), "name", False),
    ("document_number", ("document no", "passport no", "passport number", "id no", "id number", "card number",
                         "pan no", "licence no", "license no", "dl no", "consumer no", "number"), "text", False),
    ("nationality", ("nationality",), "text", False),
    ("gender", ("gender", "sex"), "gender", False),
    ("issue_date", ("date of issue", "issue date", "issued on"), "date", False),
    ("expiry_date", ("date of expiry", "expiry date", "expires on", "valid until", "valid till"), "date", False),
    ("address", ("address", "residing at"), "address", True),
    ("father_name", ("father's name", "father name", "fathers name", "father", "guardian's name",
                     "guardian name", "husband's name", "husband name", "s/o", "d/o", "w/o"), "name", True),
    ("pincode", ("pincode", "pin code", "postal code", "zip code", "pin"), "text", False),
)
FULL_NAME_SPEC = ("full_name", ("full name", "name", "holder name", "cardholder"), "name", True)
HEADER_SHARE = 0.13

# ---- fixed values: question routing (words, category, action), first match wins -----------------
CASE_INTENTS = (
    (("who is", "applicant", "name of", "person", "whose", "identity"), "identity", None),
    (("father", "guardian", "parent"), "father_name", "switch_tab:Documents"),
    (("birth", "dob", "born", "age", "how old"), "dob", "switch_tab:Documents"),
    (("address", "location", "live", "residence"), "address", "switch_tab:Documents"),
    (("fake", "fraud", "tamper", "tampered", "alter", "altered", "edit", "edited", "photoshop", "cloned",
      "forged", "genuine", "authentic", "real"), "forensics", "switch_tab:Forensics"),
    (("risk", "score", "safe", "danger", "band", "rating"), "risk_score", None),
    (("match", "mismatch", "conflict", "agree", "discrepanc", "different", "wrong"),
     "comparison", "switch_tab:Comparison"),
    (("approve", "approved", "reject", "rejected", "status", "decision", "verdict", "officer", "signed"),
     "review", None),
    (("document", "file", "card", "how many", "which id", "aadhaar", "pan", "passport", "license", "licence"),
     "documents", "switch_tab:Documents"),
    (("face", "photo", "picture", "selfie", "biometric", "look like"),
     "face_verification", "switch_tab:Face Verification"),
    (("report", "audit", "download", "dossier", "export", "pdf"), "report", "switch_tab:Report"),
    (("dashboard", "home", "main"), "navigate_dashboard", "navigate:/dashboard"),
    (("upload", "new screen", "new case", "start"), "navigate_upload", "navigate:/screen/new"),
    (("history", "past", "records"), "navigate_history", "navigate:/history"),
    (("help", "what can you", "how to", "assist", "guide"), "help", None),
)
SYSTEM_INTENTS = (
    (("dashboard", "home", "main"), "navigate", "navigate:/dashboard"),
    (("upload", "new screen", "screen document", "add case", "start"), "navigate", "navigate:/screen/new"),
    (("history", "past", "previous", "all cases"), "navigate", "navigate:/history"),
    (("report", "dossier", "audit"), "navigate", "navigate:/reports"),
    (("analytics", "trend", "statistics", "chart"), "navigate", "navigate:/analytics"),
    (("help", "what can you do", "how to use", "assist"), "help", None),
)

# ---- fixed values: layout zones as fractions, structural zones, editor names ---------------------
ZONES = {
    "passport": (("photo zone", 0.66, 0.20, 0.95, 0.68), ("text band", 0.03, 0.18, 0.66, 0.80),
                 ("MRZ band", 0.0, 0.80, 1.0, 1.0), ("header band", 0.0, 0.0, 1.0, 0.16)),
    "national_id": (("photo zone", 0.66, 0.20, 0.95, 0.68), ("QR zone", 0.66, 0.62, 0.96, 0.94),
                    ("text band", 0.03, 0.18, 0.66, 0.92), ("header band", 0.0, 0.0, 1.0, 0.16)),
    "pan": (("photo zone", 0.66, 0.20, 0.95, 0.68), ("QR zone", 0.66, 0.62, 0.96, 0.94),
            ("text band", 0.03, 0.18, 0.66, 0.92), ("header band", 0.0, 0.0, 1.0, 0.16)),
    "driving_licence": (("photo zone", 0.66, 0.20, 0.95, 0.68), ("text band", 0.03, 0.18, 0.66, 0.92),
                        ("header band", 0.0, 0.0, 1.0, 0.16)),
}
STRUCTURAL_ZONES = ("QR zone", "MRZ band")
STRUCTURAL_CAP = 0.25
EDITOR_NAMES = ("photoshop", "gimp", "canva", "picsart", "pixelmator", "paint.net", "coreldraw", "inkscape",
                "affinity", "illustrator")
CELL_PIXELS = 16
LEAST_CLUSTER_CELLS = 3
