"""Reference data and vocabularies.

Everything in this module is a fixed value: a wire code, a registry name, a threshold or a
label that the posture tables must carry verbatim.  The small dimension frames built from
them have at most about a hundred rows, so they are always safe to broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ------------------------------------------------------------------ fixed values: dissection
#: logical name -> dissector field names, preferred first
FIELD_NAMES = {
    "frame_number": ["frame_frame_number"],
    "time_epoch": ["frame_frame_time_epoch"],
    "frame_len": ["frame_frame_len", "frame_frame_cap_len"],
    "protocols": ["frame_frame_protocols"],
    "src_ip": ["ip_ip_src", "ipv6_ipv6_src"],
    "dst_ip": ["ip_ip_dst", "ipv6_ipv6_dst"],
    "src_port": ["tcp_tcp_srcport", "udp_udp_srcport"],
    "dst_port": ["tcp_tcp_dstport", "udp_udp_dstport"],
    "tcp_stream": ["tcp_tcp_stream"],
    "tcp_seq": ["tcp_tcp_seq"],
    "tcp_flags": ["tcp_tcp_flags"],
    "tcp_payload": ["tcp_tcp_payload"],
    "tls_record_version": ["tls_tls_record_version"],
    "tls_handshake_type": ["tls_tls_handshake_type"],
    "tls_handshake_version": ["tls_tls_handshake_version"],
    "tls_ciphersuite": ["tls_tls_handshake_ciphersuite"],
    "tls_sni": ["tls_tls_handshake_extensions_server_name"],
    "tls_supported_version": ["tls_tls_handshake_extensions_supported_version"],
    "tls_session_id": ["tls_tls_handshake_session_id"],
    "tls_app_data": ["tls_tls_app_data"],
    "tls_key_share_group": ["tls_tls_handshake_extensions_key_share_group"],
    "smtp_command": ["smtp_smtp_req_command"],
    "smtp_command_line": ["smtp_smtp_command_line"],
    "smtp_response_code": ["smtp_smtp_response_code"],
    "smtp_response_params": ["smtp_smtp_rsp_parameter"],
    "imap_command": ["imap_imap_request_command"],
    "imap_response_status": ["imap_imap_response_status"],
    "imap_lines": ["imap_imap_line"],
    "pop_command": ["pop_pop_request_command"],
    "pop_response_indicator": ["pop_pop_response_indicator"],
    "pop_response_description": ["pop_pop_response_description"],
}

#: logical X.509 list name -> dissector field names
X509_FIELD_NAMES = {
    "cert_elements": ["x509af_x509af_signedCertificate_element"],
    "serials": ["x509af_x509af_serialNumber"],
    "versions": ["x509af_x509af_version"],
    "validity_utc": ["x509af_x509af_utcTime"],
    "rsa_moduli": ["pkixalgs_pkixalgs_modulus"],
    "rsa_exponents": ["pkixalgs_pkixalgs_publicExponent"],
    "subject_key_ids": ["x509ce_x509ce_SubjectKeyIdentifier"],
    "authority_key_ids": ["x509ce_x509ce_keyIdentifier"],
    "san_dns": ["x509ce_x509ce_dNSName"],
    "dn_text": ["x509sat_x509sat_uTF8String", "x509sat_x509sat_printableString"],
    "algorithm_ids": ["x509af_x509af_algorithm_id"],
    "extension_ids": ["x509af_x509af_extension_id"],
}

#: protocol-stack token -> canonical mail protocol
PROTOCOL_TOKENS = {"smtp": "smtp", "imap": "imap", "pop": "pop3"}

#: port -> (mail protocol, implicit TLS)
MAIL_PORTS = {
    25: ("smtp", False), 587: ("smtp", False), 465: ("smtp", True),
    143: ("imap", False), 993: ("imap", True),
    110: ("pop3", False), 995: ("pop3", True),
}

#: port -> service class used by the feature vector
PORT_CLASSES = {25: "smtp", 587: "submission", 465: "smtps", 143: "imap",
                993: "imaps", 110: "pop3", 995: "pop3s"}

MAX_FRAMES = 2_000_000
TLS_VERSIONS = {0x0200: "SSL2.0", 0x0300: "SSL3.0", 0x0301: "TLS1.0",
                0x0302: "TLS1.1", 0x0303: "TLS1.2", 0x0304: "TLS1.3"}
VERSION_RANK = {"SSL2.0": 0, "SSL3.0": 1, "TLS1.0": 2, "TLS1.1": 3, "TLS1.2": 4, "TLS1.3": 5}

EVIDENCE_STATES = ["OBSERVED", "INFERRED", "UNKNOWN", "AMBIGUOUS", "INCOMPLETE", "NOT_OBSERVABLE"]
PROVENANCES = ["observed", "inherited", "historical", "retrieved", "decrypted", "none"]
EVIDENCE_FIELDS = [
    "starttls_advertised", "starttls_requested", "starttls_accepted", "tls_transition",
    "tls_negotiated_version", "tls_cipher_suite", "tls_cipher_suite_name", "tls_key_exchange",
    "tls_named_group", "tls_forward_secrecy", "tls_certificate_chain",
    "plaintext_continuation", "auth_activity",
]
COVERAGE_FIELDS = [
    "starttls_advertised", "starttls_requested", "starttls_accepted", "tls_transition",
    "tls_negotiated_version", "tls_cipher_suite", "plaintext_continuation", "auth_activity",
]

#: dialogue states and the event that moves one to the next
APP_STATES = [
    "CONNECTED", "GREETING_OBSERVED", "CAPABILITY_REQUESTED", "CAPABILITY_OBSERVED",
    "STARTTLS_ADVERTISED", "STARTTLS_REQUESTED", "STARTTLS_ACCEPTED", "STARTTLS_REJECTED",
    "TLS_NEGOTIATING", "TLS_ESTABLISHED", "PLAINTEXT_CONTINUATION", "IMPLICIT_TLS",
    "CLOSED", "INCOMPLETE",
]
TLS_STATES = ["NONE", "CLIENT_HELLO_OBSERVED", "SERVER_HELLO_OBSERVED", "ESTABLISHED",
              "HANDSHAKE_INTERRUPTED"]
DIALOGUE_EDGES = [
    ("greeting", "CONNECTED", "GREETING_OBSERVED"),
    ("capability_request", "CONNECTED", "CAPABILITY_REQUESTED"),
    ("capability_request", "GREETING_OBSERVED", "CAPABILITY_REQUESTED"),
    ("capability_response", "CAPABILITY_REQUESTED", "CAPABILITY_OBSERVED"),
    ("capability_response", "GREETING_OBSERVED", "CAPABILITY_OBSERVED"),
    ("starttls_advertised", "CAPABILITY_OBSERVED", "STARTTLS_ADVERTISED"),
    ("starttls_command", "STARTTLS_ADVERTISED", "STARTTLS_REQUESTED"),
    ("starttls_command", "CAPABILITY_OBSERVED", "STARTTLS_REQUESTED"),
    ("starttls_command", "GREETING_OBSERVED", "STARTTLS_REQUESTED"),
    ("starttls_accepted", "STARTTLS_REQUESTED", "STARTTLS_ACCEPTED"),
    ("starttls_rejected", "STARTTLS_REQUESTED", "STARTTLS_REJECTED"),
    ("plaintext_command", "CAPABILITY_OBSERVED", "PLAINTEXT_CONTINUATION"),
    ("plaintext_command", "STARTTLS_ADVERTISED", "PLAINTEXT_CONTINUATION"),
    ("plaintext_command", "STARTTLS_REJECTED", "PLAINTEXT_CONTINUATION"),
    ("plaintext_command", "GREETING_OBSERVED", "PLAINTEXT_CONTINUATION"),
    ("auth_command", "CAPABILITY_OBSERVED", "PLAINTEXT_CONTINUATION"),
    ("auth_command", "STARTTLS_ADVERTISED", "PLAINTEXT_CONTINUATION"),
    ("auth_command", "STARTTLS_REJECTED", "PLAINTEXT_CONTINUATION"),
    ("auth_command", "GREETING_OBSERVED", "PLAINTEXT_CONTINUATION"),
    ("auth_command", "PLAINTEXT_CONTINUATION", "PLAINTEXT_CONTINUATION"),
]

#: SMTP commands that end the capability phase, as prefixes
SMTP_PHASE_ENDING = ["STARTTLS", "STAR", "AUTH", "MAIL", "RCPT", "DATA", "QUIT",
                     "BDAT", "VRFY", "EXPN", "NOOP", "RSET"]
SMTP_PLAINTEXT = ["MAIL", "RCPT", "DATA", "VRFY", "EXPN", "NOOP", "RSET"]
IMAP_PLAINTEXT = ["SELECT", "EXAMINE", "LIST", "FETCH", "LOGOUT"]
POP3_PLAINTEXT = ["STAT", "LIST", "RETR", "DELE", "QUIT", "UIDL", "TOP"]
CAPABILITY_LINE = r"(?i)^250[- ]STARTTLS\s*$"

# ------------------------------------------------------------------ fixed values: crypto
#: IANA cipher suite code -> standard name
SUITE_NAMES = {
    0x0000: "TLS_NULL_WITH_NULL_NULL",
    0x0001: "TLS_RSA_WITH_NULL_MD5",
    0x0002: "TLS_RSA_WITH_NULL_SHA",
    0x0003: "TLS_RSA_EXPORT_WITH_RC4_40_MD5",
    0x0004: "TLS_RSA_WITH_RC4_128_MD5",
    0x0005: "TLS_RSA_WITH_RC4_128_SHA",
    0x0008: "TLS_RSA_EXPORT_WITH_DES40_CBC_SHA",
    0x0009: "TLS_RSA_WITH_DES_CBC_SHA",
    0x000A: "TLS_RSA_WITH_3DES_EDE_CBC_SHA",
    0x0014: "TLS_DHE_RSA_EXPORT_WITH_DES40_CBC_SHA",
    0x0015: "TLS_DHE_RSA_WITH_DES_CBC_SHA",
    0x0016: "TLS_DHE_RSA_WITH_3DES_EDE_CBC_SHA",
    0x0018: "TLS_DH_anon_WITH_RC4_128_MD5",
    0x001B: "TLS_DH_anon_WITH_3DES_EDE_CBC_SHA",
    0x002F: "TLS_RSA_WITH_AES_128_CBC_SHA",
    0x0032: "TLS_DHE_DSS_WITH_AES_128_CBC_SHA",
    0x0033: "TLS_DHE_RSA_WITH_AES_128_CBC_SHA",
    0x0034: "TLS_DH_anon_WITH_AES_128_CBC_SHA",
    0x0035: "TLS_RSA_WITH_AES_256_CBC_SHA",
    0x0038: "TLS_DHE_DSS_WITH_AES_256_CBC_SHA",
    0x0039: "TLS_DHE_RSA_WITH_AES_256_CBC_SHA",
    0x003A: "TLS_DH_anon_WITH_AES_256_CBC_SHA",
    0x003B: "TLS_RSA_WITH_NULL_SHA256",
    0x003C: "TLS_RSA_WITH_AES_128_CBC_SHA256",
    0x003D: "TLS_RSA_WITH_AES_256_CBC_SHA256",
    0x0040: "TLS_DHE_DSS_WITH_AES_128_CBC_SHA256",
    0x0041: "TLS_RSA_WITH_CAMELLIA_128_CBC_SHA",
    0x0044: "TLS_DHE_DSS_WITH_CAMELLIA_128_CBC_SHA",
    0x0045: "TLS_DHE_RSA_WITH_CAMELLIA_128_CBC_SHA",
    0x0067: "TLS_DHE_RSA_WITH_AES_128_CBC_SHA256",
    0x006A: "TLS_DHE_DSS_WITH_AES_256_CBC_SHA256",
    0x006B: "TLS_DHE_RSA_WITH_AES_256_CBC_SHA256",
    0x0084: "TLS_RSA_WITH_CAMELLIA_256_CBC_SHA",
    0x0087: "TLS_DHE_DSS_WITH_CAMELLIA_256_CBC_SHA",
    0x0088: "TLS_DHE_RSA_WITH_CAMELLIA_256_CBC_SHA",
    0x009C: "TLS_RSA_WITH_AES_128_GCM_SHA256",
    0x009D: "TLS_RSA_WITH_AES_256_GCM_SHA384",
    0x009E: "TLS_DHE_RSA_WITH_AES_128_GCM_SHA256",
    0x009F: "TLS_DHE_RSA_WITH_AES_256_GCM_SHA384",
    0x00A2: "TLS_DHE_DSS_WITH_AES_128_GCM_SHA256",
    0x00A3: "TLS_DHE_DSS_WITH_AES_256_GCM_SHA384",
    0x00BA: "TLS_RSA_WITH_CAMELLIA_128_CBC_SHA256",
    0x00BD: "TLS_DHE_DSS_WITH_CAMELLIA_128_CBC_SHA256",
    0x00BE: "TLS_DHE_RSA_WITH_CAMELLIA_128_CBC_SHA256",
    0x00C0: "TLS_RSA_WITH_CAMELLIA_256_CBC_SHA256",
    0x00C3: "TLS_DHE_DSS_WITH_CAMELLIA_256_CBC_SHA256",
    0x00C4: "TLS_DHE_RSA_WITH_CAMELLIA_256_CBC_SHA256",
    0x1301: "TLS_AES_128_GCM_SHA256",
    0x1302: "TLS_AES_256_GCM_SHA384",
    0x1303: "TLS_CHACHA20_POLY1305_SHA256",
    0xC001: "TLS_ECDH_ECDSA_WITH_NULL_SHA",
    0xC003: "TLS_ECDH_ECDSA_WITH_3DES_EDE_CBC_SHA",
    0xC004: "TLS_ECDH_ECDSA_WITH_AES_128_CBC_SHA",
    0xC005: "TLS_ECDH_ECDSA_WITH_AES_256_CBC_SHA",
    0xC007: "TLS_ECDHE_ECDSA_WITH_RC4_128_SHA",
    0xC008: "TLS_ECDHE_ECDSA_WITH_3DES_EDE_CBC_SHA",
    0xC009: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA",
    0xC00A: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA",
    0xC00B: "TLS_ECDH_RSA_WITH_NULL_SHA",
    0xC00D: "TLS_ECDH_RSA_WITH_3DES_EDE_CBC_SHA",
    0xC00E: "TLS_ECDH_RSA_WITH_AES_128_CBC_SHA",
    0xC00F: "TLS_ECDH_RSA_WITH_AES_256_CBC_SHA",
    0xC011: "TLS_ECDHE_RSA_WITH_RC4_128_SHA",
    0xC012: "TLS_ECDHE_RSA_WITH_3DES_EDE_CBC_SHA",
    0xC013: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA",
    0xC014: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA",
    0xC023: "TLS_ECDHE_ECDSA_WITH_AES_128_CBC_SHA256",
    0xC024: "TLS_ECDHE_ECDSA_WITH_AES_256_CBC_SHA384",
    0xC027: "TLS_ECDHE_RSA_WITH_AES_128_CBC_SHA256",
    0xC028: "TLS_ECDHE_RSA_WITH_AES_256_CBC_SHA384",
    0xC02B: "TLS_ECDHE_ECDSA_WITH_AES_128_GCM_SHA256",
    0xC02C: "TLS_ECDHE_ECDSA_WITH_AES_256_GCM_SHA384",
    0xC02F: "TLS_ECDHE_RSA_WITH_AES_128_GCM_SHA256",
    0xC030: "TLS_ECDHE_RSA_WITH_AES_256_GCM_SHA384",
    0xC050: "TLS_RSA_WITH_ARIA_128_GCM_SHA256",
    0xC051: "TLS_RSA_WITH_ARIA_256_GCM_SHA384",
    0xC052: "TLS_DHE_RSA_WITH_ARIA_128_GCM_SHA256",
    0xC053: "TLS_DHE_RSA_WITH_ARIA_256_GCM_SHA384",
    0xC056: "TLS_DHE_DSS_WITH_ARIA_128_GCM_SHA256",
    0xC057: "TLS_DHE_DSS_WITH_ARIA_256_GCM_SHA384",
    0xC05C: "TLS_ECDHE_ECDSA_WITH_ARIA_128_GCM_SHA256",
    0xC05D: "TLS_ECDHE_ECDSA_WITH_ARIA_256_GCM_SHA384",
    0xC060: "TLS_ECDHE_RSA_WITH_ARIA_128_GCM_SHA256",
    0xC061: "TLS_ECDHE_RSA_WITH_ARIA_256_GCM_SHA384",
    0xC072: "TLS_ECDHE_ECDSA_WITH_CAMELLIA_128_CBC_SHA256",
    0xC073: "TLS_ECDHE_ECDSA_WITH_CAMELLIA_256_CBC_SHA384",
    0xC076: "TLS_ECDHE_RSA_WITH_CAMELLIA_128_CBC_SHA256",
    0xC077: "TLS_ECDHE_RSA_WITH_CAMELLIA_256_CBC_SHA384",
    0xC09C: "TLS_RSA_WITH_AES_128_CCM",
    0xC09D: "TLS_RSA_WITH_AES_256_CCM",
    0xC09E: "TLS_DHE_RSA_WITH_AES_128_CCM",
    0xC09F: "TLS_DHE_RSA_WITH_AES_256_CCM",
    0xC0AC: "TLS_ECDHE_ECDSA_WITH_AES_128_CCM",
    0xC0AD: "TLS_ECDHE_ECDSA_WITH_AES_256_CCM",
    0xCCA8: "TLS_ECDHE_RSA_WITH_CHACHA20_POLY1305_SHA256",
    0xCCA9: "TLS_ECDHE_ECDSA_WITH_CHACHA20_POLY1305_SHA256",
    0xCCAA: "TLS_DHE_RSA_WITH_CHACHA20_POLY1305_SHA256",
}

NAMED_GROUPS = {23: "secp256r1", 24: "secp384r1", 25: "secp521r1", 29: "x25519", 30: "x448",
                256: "ffdhe2048", 257: "ffdhe3072", 258: "ffdhe4096", 259: "ffdhe6144",
                260: "ffdhe8192"}

#: signature OID -> (name, public-key algorithm, hash)
SIGNATURE_OIDS = {
    "1.2.840.113549.1.1.2": ("md2WithRSAEncryption", "RSA", "MD2"),
    "1.2.840.113549.1.1.4": ("md5WithRSAEncryption", "RSA", "MD5"),
    "1.2.840.113549.1.1.5": ("sha1WithRSAEncryption", "RSA", "SHA-1"),
    "1.2.840.113549.1.1.10": ("rsassaPss", "RSA", "PSS-parameterised"),
    "1.2.840.113549.1.1.11": ("sha256WithRSAEncryption", "RSA", "SHA-256"),
    "1.2.840.113549.1.1.12": ("sha384WithRSAEncryption", "RSA", "SHA-384"),
    "1.2.840.113549.1.1.13": ("sha512WithRSAEncryption", "RSA", "SHA-512"),
    "1.2.840.113549.1.1.14": ("sha224WithRSAEncryption", "RSA", "SHA-224"),
    "1.2.840.10045.4.1": ("ecdsa-with-SHA1", "EC", "SHA-1"),
    "1.2.840.10045.4.3.1": ("ecdsa-with-SHA224", "EC", "SHA-224"),
    "1.2.840.10045.4.3.2": ("ecdsa-with-SHA256", "EC", "SHA-256"),
    "1.2.840.10045.4.3.3": ("ecdsa-with-SHA384", "EC", "SHA-384"),
    "1.2.840.10045.4.3.4": ("ecdsa-with-SHA512", "EC", "SHA-512"),
    "1.2.840.10040.4.3": ("dsa-with-sha1", "DSA", "SHA-1"),
    "2.16.840.1.101.3.4.3.2": ("dsa-with-sha256", "DSA", "SHA-256"),
    "1.3.101.112": ("Ed25519", "Ed25519", "SHA-512 (intrinsic)"),
    "1.3.101.113": ("Ed448", "Ed448", "SHAKE256 (intrinsic)"),
}
PUBLIC_KEY_OIDS = {
    "1.2.840.113549.1.1.1": "RSA", "1.2.840.113549.1.1.10": "RSASSA-PSS",
    "1.2.840.10045.2.1": "EC", "1.2.840.10040.4.1": "DSA", "1.2.840.113549.1.3.1": "DH",
    "1.3.101.112": "Ed25519", "1.3.101.113": "Ed448",
}
CURVE_OIDS = {
    "1.2.840.10045.3.1.1": "secp192r1", "1.3.132.0.33": "secp224r1",
    "1.2.840.10045.3.1.7": "secp256r1", "1.3.132.0.34": "secp384r1",
    "1.3.132.0.35": "secp521r1", "1.3.132.0.10": "secp256k1",
}
EXTENSION_OIDS = {
    "2.5.29.14": "subjectKeyIdentifier", "2.5.29.15": "keyUsage",
    "2.5.29.17": "subjectAltName", "2.5.29.19": "basicConstraints",
    "2.5.29.31": "cRLDistributionPoints", "2.5.29.32": "certificatePolicies",
    "2.5.29.35": "authorityKeyIdentifier", "2.5.29.37": "extKeyUsage",
    "1.3.6.1.5.5.7.1.1": "authorityInfoAccess",
    "1.3.6.1.4.1.11129.2.4.2": "signedCertificateTimestampList",
}
KEY_USAGE_OIDS = {
    "1.3.6.1.5.5.7.3.1": "serverAuth", "1.3.6.1.5.5.7.3.2": "clientAuth",
    "1.3.6.1.5.5.7.3.3": "codeSigning", "1.3.6.1.5.5.7.3.4": "emailProtection",
    "1.3.6.1.5.5.7.3.8": "timeStamping", "1.3.6.1.5.5.7.3.9": "OCSPSigning",
}
DEPRECATED_HASHES = ["MD2", "MD5", "SHA-1"]
MAX_CHAIN = 10
MIN_RSA_BITS = 2048

# ------------------------------------------------------------------ fixed values: posture
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
STATUSES = ["OBSERVED_ISSUE", "COMPLIANT", "INFORMATIONAL", "AMBIGUOUS",
            "INSUFFICIENT_EVIDENCE", "NOT_OBSERVABLE"]
SEVERITY_WEIGHT = {"INFO": 0.0, "LOW": 3.0, "MEDIUM": 12.0, "HIGH": 28.0, "CRITICAL": 55.0}
SEVERITY_BASE = {"INFO": 0.0, "LOW": 10.0, "MEDIUM": 40.0, "HIGH": 70.0, "CRITICAL": 100.0}
CERTAINTIES = ["UNDETERMINED", "UNCERTAIN", "PROBABLE", "CONFIRMED"]
CERTAINTY_FACTOR = {"CONFIRMED": 6.0, "PROBABLE": 3.0, "UNCERTAIN": 1.0, "UNDETERMINED": 0.0}
KIND_FACTOR = {"BASE_SECURITY_ISSUE": 5.0, "BEHAVIOURAL_DEVIATION": 2.0, "ANOMALY_SIGNAL": 0.0,
               "POSITIVE_EVIDENCE": 0.0, "ABSTENTION": 0.0}
BAND_CUTS = [(90.0, "STRONG"), (75.0, "ADEQUATE"), (50.0, "WEAK")]
FORMULAS = ["F1-instance", "F2-group-damped", "F3-worst-dominant"]
SELECTED_FORMULA = "F2-group-damped"
POSTURE_SCHEMA_VERSION = "1.0"

#: rule -> issue class
RULE_CLASS = {
    "SEC-TLS-001": "DEPRECATED_TLS_VERSION",
    "SEC-TLS-002": "TLS_HANDSHAKE_EVIDENCE",
    "SEC-TLS-003": "CERTIFICATE_OBSERVABILITY",
    "SEC-STLS-001": "STARTTLS_UPGRADE_FAILURE",
    "SEC-STLS-002": "STARTTLS_ADVERTISEMENT",
    "SEC-STLS-003": "IMPLICIT_TLS_SESSION",
    "SEC-PLAIN-001": "PLAINTEXT_AUTH_EXPOSURE",
    "SEC-PLAIN-002": "NO_TLS_PROTECTION",
    "CS-STARTTLS-001": "STARTTLS_BEHAVIOUR_DEVIATION",
    "CS-STARTTLS-002": "STARTTLS_BEHAVIOUR_DEVIATION",
    "CS-TLS-001": "TLS_VERSION_DEVIATION",
    "SEC-KEX-001": "KEY_EXCHANGE_MECHANISM",
    "SEC-FS-001": "FORWARD_SECRECY",
    "SEC-CERT-001": "CERTIFICATE_EXTRACTION",
    "SEC-CERT-002": "CERTIFICATE_VALIDITY",
    "SEC-CERT-003": "CERTIFICATE_KEY_STRENGTH",
    "SEC-CERT-004": "CERTIFICATE_SIGNATURE_ALGORITHM",
    "SEC-CERT-005": "CERTIFICATE_CHAIN_STRUCTURE",
    "SEC-CFG-001": "INSECURE_CONFIGURATION",
}
#: issue class -> risk dimension
CLASS_DIMENSION = {
    "DEPRECATED_TLS_VERSION": "PROTOCOL_VERSION",
    "TLS_VERSION_DEVIATION": "PROTOCOL_VERSION",
    "PLAINTEXT_AUTH_EXPOSURE": "PLAINTEXT_EXPOSURE",
    "NO_TLS_PROTECTION": "PLAINTEXT_EXPOSURE",
    "STARTTLS_UPGRADE_FAILURE": "UPGRADE_INTEGRITY",
    "STARTTLS_BEHAVIOUR_DEVIATION": "BEHAVIOURAL_CONSISTENCY",
    "STARTTLS_ADVERTISEMENT": "UPGRADE_INTEGRITY",
    "TLS_HANDSHAKE_EVIDENCE": "CRYPTO_CONFIGURATION",
    "IMPLICIT_TLS_SESSION": "CRYPTO_CONFIGURATION",
    "CERTIFICATE_OBSERVABILITY": "CERTIFICATE_TRUST",
    "KEY_EXCHANGE_MECHANISM": "CRYPTO_CONFIGURATION",
    "FORWARD_SECRECY": "CRYPTO_CONFIGURATION",
    "CERTIFICATE_EXTRACTION": "CERTIFICATE_TRUST",
    "CERTIFICATE_VALIDITY": "CERTIFICATE_TRUST",
    "CERTIFICATE_KEY_STRENGTH": "CERTIFICATE_TRUST",
    "CERTIFICATE_SIGNATURE_ALGORITHM": "CERTIFICATE_TRUST",
    "CERTIFICATE_CHAIN_STRUCTURE": "CERTIFICATE_TRUST",
    "INSECURE_CONFIGURATION": "CRYPTO_CONFIGURATION",
    "ANOMALY": "BEHAVIOURAL_CONSISTENCY",
    "UNCLASSIFIED": "CRYPTO_CONFIGURATION",
}
#: status -> abstention reason
ABSTAIN_REASON = {"AMBIGUOUS": "AMBIGUOUS_EVIDENCE",
                  "INSUFFICIENT_EVIDENCE": "INSUFFICIENT_CAPTURE",
                  "NOT_OBSERVABLE": "NOT_OBSERVABLE"}
#: ordered substring marker -> (standard, section)
STANDARD_MARKERS = [
    ("RFC 8996", "RFC 8996 (BCP 195)", "SS4-5"),
    ("NIST SP 800-52r2", "NIST SP 800-52r2", "SS3.1"),
    ("RFC 3207", "RFC 3207", "SS6"),
    ("RFC 2595", "RFC 2595", ""),
    ("RFC 8314", "RFC 8314", "SS3"),
]
UNMAPPED = "UNMAPPED"
#: job states, and the edges the audit allows
JOB_EDGES = [
    ("CREATED", "VALIDATING"), ("CREATED", "FAILED"), ("CREATED", "CANCELLED"),
    ("CREATED", "RECOVERY_REQUIRED"),
    ("VALIDATING", "QUEUED"), ("VALIDATING", "FAILED"), ("VALIDATING", "CANCELLED"),
    ("VALIDATING", "RECOVERY_REQUIRED"),
    ("QUEUED", "RUNNING"), ("QUEUED", "FAILED"), ("QUEUED", "CANCELLED"),
    ("QUEUED", "RECOVERY_REQUIRED"),
    ("RUNNING", "FINALIZING"), ("RUNNING", "FAILED"), ("RUNNING", "CANCELLED"),
    ("RUNNING", "RECOVERY_REQUIRED"),
    ("FINALIZING", "COMPLETED"), ("FINALIZING", "FAILED"), ("FINALIZING", "RECOVERY_REQUIRED"),
    ("RECOVERY_REQUIRED", "FAILED"),
]
INTERRUPTIBLE = ["CREATED", "VALIDATING", "QUEUED", "RUNNING", "FINALIZING"]

#: display labels
LABELS = {
    "posture": {"STRONG": "STRONG", "ADEQUATE": "ADEQUATE", "WEAK": "WEAK",
                "CRITICAL": "CRITICAL", "INSUFFICIENT_EVIDENCE": "INSUFFICIENT EVIDENCE"},
    "severity": {"CRITICAL": "CRITICAL", "HIGH": "HIGH", "MEDIUM": "MEDIUM", "LOW": "LOW",
                 "INFO": "INFO"},
    "status": {"OBSERVED_ISSUE": "OBSERVED ISSUE", "COMPLIANT": "COMPLIANT",
               "AMBIGUOUS": "AMBIGUOUS", "INSUFFICIENT_EVIDENCE": "INSUFFICIENT EVIDENCE",
               "NOT_OBSERVABLE": "NOT OBSERVABLE"},
    "certainty": {"CONFIRMED": "CONFIRMED", "PROBABLE": "PROBABLE", "UNCERTAIN": "UNCERTAIN",
                  "UNDETERMINED": "UNDETERMINED"},
    "observability": {"OBSERVABLE": "OBSERVABLE",
                      "PARTIALLY_OBSERVABLE": "PARTIALLY OBSERVABLE",
                      "NOT_OBSERVABLE": "NOT OBSERVABLE"},
    "fact_kind": {"BASE_SECURITY_ISSUE": "Security issue",
                  "BEHAVIOURAL_DEVIATION": "Behavioural deviation",
                  "ANOMALY_SIGNAL": "Anomaly signal",
                  "POSITIVE_EVIDENCE": "Positive evidence", "ABSTENTION": "Abstention"},
    "abstention_reason": {"INSUFFICIENT_HISTORY": "Insufficient history",
                          "AMBIGUOUS_EVIDENCE": "Ambiguous evidence",
                          "NOT_OBSERVABLE": "Not observable",
                          "INSUFFICIENT_CAPTURE": "Insufficient capture",
                          "CONTRADICTORY_EVIDENCE": "Contradictory evidence",
                          "UNSUPPORTED_PROTOCOL_VARIANT": "Unsupported protocol variant",
                          "NOT_COMPARABLE": "Not comparable"},
    "dimension": {"PROTOCOL_VERSION": "Protocol version",
                  "PLAINTEXT_EXPOSURE": "Plaintext exposure",
                  "UPGRADE_INTEGRITY": "Upgrade integrity",
                  "CRYPTO_CONFIGURATION": "Crypto configuration",
                  "CERTIFICATE_TRUST": "Certificate trust",
                  "BEHAVIOURAL_CONSISTENCY": "Behavioural consistency"},
    "job_state": {"CREATED": "Created", "VALIDATING": "Validating", "QUEUED": "Queued",
                  "RUNNING": "Running", "FINALIZING": "Finalizing", "COMPLETED": "Completed",
                  "FAILED": "Failed", "CANCELLED": "Cancelled",
                  "RECOVERY_REQUIRED": "Interrupted"},
}
SEVERITY_MARKER = {"CRITICAL": "[!!!]", "HIGH": "[!! ]", "MEDIUM": "[!  ]", "LOW": "[.  ]",
                   "INFO": "[i  ]"}
DISPLAY_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]
UNATTRIBUTED = "__unattributed__"
UNATTRIBUTED_LABEL = "Not attributed to a protocol"
MAX_CLIP = 2000
#: (id, display order) of the overview distributions
OTHER = "__other__"
NO_PROTOCOL = "__none__"
# ------------------------------------------------------------------ end of fixed values


def _bulk_cipher(name: str) -> tuple[str, str]:
    """(encryption, MAC) of a suite, read from its standard name."""
    tail = name.split("_WITH_")[-1] if "_WITH_" in name else name[len("TLS_"):]
    words = tail.split("_")
    digest = {"SHA": "SHA1"}.get(words[-1], words[-1])
    if "CHACHA20" in words:
        return "CHACHA20/POLY1305(256)", "AEAD"
    for mode in ("GCM", "CCM"):
        if mode in words:
            return f"{words[0]}{mode}({words[1]})", "AEAD"
    fixed_strength = {"3DES": "3DES(168)", "DES": "DES(56)", "DES40": "DES(40)", "NULL": "NULL"}
    if words[0] in fixed_strength:
        return fixed_strength[words[0]], digest
    family = {"CAMELLIA": "Camellia"}.get(words[0], words[0])
    return f"{family}({words[1]})", digest


def _handshake_part(name: str) -> tuple[str | None, str | None, bool | None]:
    """(key exchange, authentication, ephemeral); all null for the 1.3 suites."""
    if "_WITH_" not in name:
        return None, None, None
    part = name[len("TLS_"):name.index("_WITH_")].replace("_EXPORT", "")
    if part == "DH_anon":
        return "DH_anon", "anon", True
    words = part.split("_")
    return words[0], words[-1], words[0] in ("ECDHE", "DHE", "SRP")


def suite_rows() -> list[tuple]:
    return [(code, f"0x{code:04x}", name, *_handshake_part(name)[:2], *_bulk_cipher(name),
             "_WITH_" not in name, _handshake_part(name)[2])
            for code, name in SUITE_NAMES.items()]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline(spark: SparkSession, rows, schema: str) -> DataFrame:
    """A small constant frame as an in-plan relation, so its size is known to the optimizer."""
    columns = [c.strip().split(" ") for c in schema.split(",")]
    names = ", ".join(name for name, _ in columns)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in columns)
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def dim_suite(spark: SparkSession) -> DataFrame:
    return inline(
        spark, suite_rows(),
        "code int, suite_hex string, suite_name string, kex string, auth string, enc string, "
        "mac string, is_tls13 boolean, ephemeral boolean")


def dim_group(spark: SparkSession) -> DataFrame:
    return inline(spark, NAMED_GROUPS.items(), "group_code int, group_name string")


def dim_signature(spark: SparkSession) -> DataFrame:
    rows = [(oid, *rest, rest[2] in DEPRECATED_HASHES) for oid, rest in SIGNATURE_OIDS.items()]
    return inline(spark, rows,
                  "oid string, sig_name string, sig_key string, sig_hash string, "
                  "deprecated boolean")


def oid_rows() -> list[tuple[str, str]]:
    """One display name per OID; earlier tables win."""
    out: dict[str, str] = {}
    for table in (EXTENSION_OIDS, KEY_USAGE_OIDS, PUBLIC_KEY_OIDS,
                  {k: v[0] for k, v in SIGNATURE_OIDS.items()}, CURVE_OIDS):
        for oid, name in table.items():
            out.setdefault(oid, name)
    return list(out.items())


def dim_oid(spark: SparkSession) -> DataFrame:
    return inline(spark, oid_rows(), "oid string, oid_name string")


def dim_class(spark: SparkSession) -> DataFrame:
    rows = [(rule, cls, CLASS_DIMENSION[cls]) for rule, cls in RULE_CLASS.items()]
    return inline(spark, rows, "rule_id string, issue_class string, dimension string")


def dim_edges(spark: SparkSession) -> DataFrame:
    return inline(spark, JOB_EDGES, "from_state string, to_state string")
