"""Closed vocabularies and rule tables.

Everything in this module is a fixed value: the data feeds, saved assessments and
result labels use these exact words and numbers, so they are stated as plain text.
"""

# --- risk model (fixed values) ------------------------------------------------
RISK_MODEL_VERSION = "2026.09.1"
LIKELIHOODS = ["Low evidence", "Plausible", "Elevated", "Active"]
ACTIONS = ["Defer and review", "Scheduled", "Out-of-cycle", "Immediate"]
PRIORITY_LABELS = {
    "Immediate": "Emergency",
    "Out-of-cycle": "Expedited",
    "Scheduled": "Normal scheduled",
    "Defer and review": "No customer action",
}
TILE_STATES = {
    "Immediate": "emergency",
    "Out-of-cycle": "expedited",
    "Scheduled": "scheduled",
    "Defer and review": "no-action",
}
VENDOR_LIKELIHOOD = {
    "detected": 3, "more-likely": 2, "less-likely": 1, "unlikely": 0, "unknown": 1,
}
VENDOR_LIKELIHOOD_LABELS = {
    "detected": "Detected", "more-likely": "More likely", "less-likely": "Less likely",
    "unlikely": "Unlikely", "unknown": "Not published",
}
EPSS_ELEVATED = 0.10
EPSS_PLAUSIBLE = 0.01
ORDINARY_CREDIT_CAP = 1
PATH_BLOCK_CREDIT_CAP = 2
CONSEQUENCE_CREDIT_CAP = 1

# archetype -> (action, floor without path block, floor with path block, reason)
ARCHETYPES = {
    "no-customer-action": (0, 0, 0, "Microsoft states that no customer action is required"),
    "active-exploitation": (
        3, 2, 2,
        "Confirmed exploitation requires immediate triage and an out-of-cycle remediation floor"),
    "critical-preauth-network-rce": (
        3, 2, 1,
        "Critical pre-authentication network RCE with elevated exploitation evidence"),
    "critical-technical": (
        2, 0, 0, "Critical technical severity requires out-of-cycle remediation"),
    "elevated-high-severity": (
        2, 0, 0,
        "Elevated exploitation likelihood and high technical severity require "
        "out-of-cycle remediation"),
    "unknown-severity": (
        1, 0, 0,
        "The vendor published neither a severity rating nor a CVSS score. Scheduled is a "
        "placeholder pending review, not a finding of low risk"),
    "standard-remediation": (
        1, 0, 0, "Current evidence supports normal scheduled remediation"),
}
FACTORS = ["applicability", "threat_evidence", "exploitability", "technical_impact",
           "workload_context", "remediation_context", "uncertainty"]
COMMUNICATION = ["summary", "why_this_action", "control_limitations", "reassessment_triggers"]
DIRECTIONS = ["inbound", "outbound", "local", "adjacent", "unknown"]

# --- severity (fixed values) --------------------------------------------------
BAND_RANK = {"unknown": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
BANDS = ["critical", "high", "medium", "low", "unknown"]
SCALES_VERSION = "1.0"
SEVERITY_SCALES = {
    "msrc": {"Critical": "critical", "Important": "high", "Moderate": "medium", "Low": "low"},
    "chromium": {"Critical": "critical", "High": "high", "Medium": "medium", "Low": "low"},
    "mozilla": {"Critical": "critical", "High": "high", "Moderate": "medium", "Low": "low"},
    "adobe": {"Critical": "critical", "Important": "high", "Moderate": "medium"},
    "cvss-qualitative": {"CRITICAL": "critical", "HIGH": "high", "MEDIUM": "medium",
                         "LOW": "low", "NONE": "unknown"},
}
# closed ranges; a score in a gap (8.95) belongs to no band
SCORE_BANDS = [(9.0, 10.0, "critical"), (7.0, 8.9, "high"), (4.0, 6.9, "medium"),
               (0.1, 3.9, "low"), (0.0, 0.0, "unknown")]
LEGACY_BANDS = {"Critical": "critical", "Important": "high", "Moderate": "medium",
                "Low": "low", "Unknown": "unknown"}
DECLINED_REASON = "Microsoft does not rate CVEs assigned by another CNA"

# --- control catalogue (fixed values): id, name, category, directions ------------
_ALL = ["inbound", "outbound", "local", "adjacent"]
_PATHS = ["inbound", "outbound", "adjacent"]
CONTROLS = [
    ("remove_external_exposure", "Remove external exposure", "Network prevention", ["inbound"]),
    ("segmentation_acl", "Segmentation and restrictive ACLs", "Network prevention", _PATHS),
    ("service_disabled_vendor_guidance", "Disable vulnerable service or feature",
     "Vendor-aligned prevention", _ALL),
    ("vendor_workaround", "Apply vendor workaround", "Vendor-aligned prevention", _ALL),
    ("exploit_specific_ips", "Exploit-specific IPS or NGFW rule", "Network prevention", _PATHS),
    ("waf_virtual_patch", "WAF virtual patch", "Application prevention", ["inbound"]),
    ("protocol_hardening", "Protocol or feature hardening", "Configuration prevention", _ALL),
    ("strong_authentication", "Strong authentication and access restriction",
     "Identity prevention", _ALL),
    ("least_privilege_pam", "Least privilege and privileged access management",
     "Identity containment", _ALL),
    ("application_control", "Application control or WDAC", "Execution containment", _ALL),
    ("attack_surface_reduction", "Attack surface reduction rules", "Execution prevention", _ALL),
    ("email_web_filtering", "Email and web content filtering", "Delivery prevention", _ALL),
    ("office_protected_view", "Office Protected View and macro hardening",
     "Application prevention", _ALL),
    ("edr_exploit_prevention", "EDR exploit-specific prevention", "Endpoint prevention", _ALL),
    ("edr_detection_response", "EDR detection and response coverage",
     "Detection and response", _ALL),
    ("immutable_backups", "Immutable and tested backups", "Recovery", _ALL),
    ("isolation_airgap", "Strong isolation or offline enclave", "Network prevention", _PATHS),
]
CONTROL_IDS = [row[0] for row in CONTROLS]
NETWORK_CONTROLS = ["remove_external_exposure", "segmentation_acl", "exploit_specific_ips",
                    "waf_virtual_patch", "isolation_airgap"]
RESPONSE_CONTROLS = ["edr_detection_response", "immutable_backups"]
CONTENT_CONTROLS = ["email_web_filtering", "office_protected_view"]
IDENTITY_CONTROLS = ["strong_authentication", "least_privilege_pam"]
PATH_BLOCK_CONTROLS = ["vendor_workaround", "service_disabled_vendor_guidance"]

# --- tag taxonomy (fixed values) ----------------------------------------------
NAMESPACES = {
    "vendor": ["microsoft"],
    "platform": ["azure", "copilot-studio", "dotnet", "dynamics-365", "edge", "entra-id",
                 "exchange", "fabric", "office", "power-platform", "sharepoint",
                 "skype-for-business", "sql-server", "teams", "visual-studio", "vscode",
                 "windows"],
    "deployment": ["server", "endpoint", "shared-service", "identity-control-plane"],
    "release": ["server-2012", "windows-10", "windows-11", "server-2016", "server-2019",
                "server-2022", "server-2025"],
    "workload": ["dns", "dhcp", "identity", "hyper-v", "print", "file-services",
                 "remote-desktop", "web-server", "database", "nfs", "rras", "netlogon",
                 "message-queuing", "failover-cluster", "sstp", "windows-shell", "graphics",
                 "imaging", "update-stack", "alpc", "internet-connection-sharing"],
    "delivery": ["user-content", "email", "web", "remote-service", "local-access"],
    "impact": ["remote-code-execution", "elevation-of-privilege", "security-feature-bypass",
               "information-disclosure", "denial-of-service", "spoofing"],
}
ALL_TAGS = [tag for tags in NAMESPACES.values() for tag in tags]
IMPACT_TAGS = NAMESPACES["impact"]
JUDGEMENT_TAGS = NAMESPACES["workload"] + NAMESPACES["delivery"] + NAMESPACES["impact"]

# --- product and workload tag rules (fixed values) ------------------------------
PRODUCT_TAG_RULES = [
    ("server-2012", "windows server 2012"), ("server-2016", "windows server 2016"),
    ("server-2019", "windows server 2019"), ("server-2022", "windows server 2022"),
    ("server-2025", "windows server 2025"), ("windows-10", "windows 10"),
    ("windows-11", "windows 11"), ("sharepoint", "sharepoint"),
    ("office", "microsoft 365 apps"), ("office", "microsoft office"), ("azure", "azure"),
    ("sql-server", "sql server"), ("skype-for-business", "skype for business"),
    ("copilot-studio", "copilot studio"), ("edge", "microsoft edge"),
    ("exchange", "exchange server"), ("teams", "microsoft teams"),
    ("vscode", "visual studio code"), ("visual-studio", "microsoft visual studio"),
    ("dotnet", ".net"), ("dynamics-365", "dynamics 365"),
    ("power-platform", "power platform"), ("power-platform", "power automate"),
    ("entra-id", "entra id"), ("fabric", "microsoft fabric"),
]
ENDPOINT_RELEASES = ["windows-10", "windows-11"]
SERVER_RELEASES = ["server-2012", "server-2016", "server-2019", "server-2022", "server-2025"]
IMPACT_CLASSES = ["remote code execution", "elevation of privilege", "information disclosure",
                  "denial of service", "security feature bypass", "spoofing", "tampering",
                  "cross-site scripting", "memory corruption"]
# tag -> (phrases that earn it, phrases that rule it out)
COMPONENT_RULES = {
    "identity": (["active directory", "kerberos", "netlogon", "key distribution center",
                  "local security authority", "ad fs", "ad cs"], []),
    "remote-desktop": (["remote desktop", "terminal services"], []),
    "dns": (["dns"], []),
    "dhcp": (["dhcp"], []),
    "hyper-v": (["hyper-v"], []),
    "exchange": (["exchange"], ["key exchange"]),
    "web-server": (["internet information services", "iis"], []),
}
WORKLOAD_TERMS = {
    "dns": ["dns", "domain name system", "name resolution"],
    "dhcp": ["dhcp", "dynamic host configuration"],
    "hyper-v": ["hyper-v", "virtual machine bus", "vmbus"],
    "remote-desktop": ["remote desktop", "terminal services", "rdp", "mstsc"],
    "web-server": ["iis", "internet information services", "httpd", "nginx", "apache",
                   "inets", "http server", "web server", "http.sys", "tomcat"],
    "identity": ["active directory", "domain controller", "kerberos", "netlogon", "entra",
                 "key distribution center", "kdc", "ad cs", "ad fs", "adfs",
                 "certificate services", "federation services", "domain services",
                 "azure ad", "b2c", "microsoft account", "msal", "authentication library",
                 "ntlm", "ldap"],
    "nfs": ["services for nfs", "network file system", "oncrpc"],
    "netlogon": ["netlogon"],
    "print": ["print spooler", "print provider", "print driver", "printer", "printing"],
    "file-services": ["smb", "server message block", "cifs", "samba", "file share",
                      "file server", "file sharing", "dfs namespace"],
    "database": ["sql server", "sqlite", "database", "mysql", "postgres", "mariadb"],
    "message-queuing": ["message queuing", "msmq"],
    "failover-cluster": ["failover cluster"],
    "sstp": ["sstp", "secure socket tunneling"],
    "rras": ["routing and remote access", "rras"],
    "windows-shell": ["windows shell", "explorer.exe", "shell32"],
    "graphics": ["graphics component", "graphic", "gdi", "directwrite", "direct2d", "font",
                 "gpu", "win32k", "display driver"],
    "imaging": ["image extension", "imaging component", "image codec", "heif"],
    "update-stack": ["windows update stack", "update stack", "servicing stack"],
    "alpc": ["alpc", "advanced local procedure call"],
    "internet-connection-sharing": ["internet connection sharing", "ics"],
}
NEEDS_USER_INTERACTION = ["user-content", "email", "web"]
NEEDS_NON_NETWORK = ["local-access"]
STOP_WORDS = ["the", "a", "an", "is", "are", "and", "or", "of", "to", "in", "for", "with",
              "that", "this", "by", "on", "as", "it", "be", "can", "from"]

# --- product filter board (fixed values): group id, source, (tag, label, on board) ---
FILTER_GROUPS = [
    ("products", "product_tags", [
        ("microsoft", "Microsoft", False), ("windows-11", "Windows 11", True),
        ("windows-10", "Windows 10", True), ("server-2025", "Server 2025", True),
        ("server-2022", "Server 2022", True), ("server-2019", "Server 2019", True),
        ("server-2016", "Server 2016", True), ("server-2012", "Server 2012", True),
        ("exchange", "Exchange", True), ("edge", "Edge", True),
        ("sql-server", "SQL Server", True), ("sharepoint", "SharePoint", True),
        ("office", "Office", True)]),
    ("workloads", "product_tags+tags", [
        ("identity", "Active Directory", True), ("dns", "DNS", True), ("dhcp", "DHCP", True),
        ("hyper-v", "Hyper-V", True), ("remote-desktop", "Remote Desktop", True),
        ("web-server", "IIS", True)]),
]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# --- privacy lists (fixed values) ----------------------------------------------
ALLOWED_DOMAINS = [
    "microsoft.com", "windows.net", "visualstudio.com", "google.com", "github.com",
    "nuget.org", "golang.org", "npmjs.com", "mvnrepository.com", "aka.ms", "googleblog.com",
    "githubusercontent.com", "empiricalsecurity.com", "nist.gov", "cisa.gov", "cve.org",
    "mitre.org", "first.org", "nodejs.org", "python.org", "chromium.org", "mozilla.org",
    "apache.org", "kernel.org", "gnu.org", "openssl.org", "debian.org", "ubuntu.com",
    "redhat.com", "oracle.com", "adobe.com", "apple.com", "ibm.com", "vmware.com",
    "broadcom.com", "citrix.com", "atlassian.com", "gitlab.com", "curl.se", "openwall.com",
    "packagist.org", "pypi.org", "rubygems.org", "crates.io", "maven.org", "sonatype.com",
    "w3.org", "ietf.org", "iana.org", "example.com", "example.org", "example.net",
    "localhost",
]
ROLE_LOCAL_PARTS = ["security", "secure", "psirt", "cert", "abuse", "support", "info",
                    "contact", "disclosure", "vulnerability", "vulnerabilities", "sirt"]
HOSTNAME_TLDS = [
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "io", "ai", "co",
    "me", "tv", "cloud", "dev", "app", "online", "site", "xyz", "systems", "services",
    "solutions", "tech", "digital", "au", "nz", "uk", "us", "ca", "sg", "jp", "de", "fr",
    "nl", "se", "no", "fi", "dk", "ie", "it", "es", "ch", "at", "be", "pl", "cz", "in", "id",
    "my", "ph", "th", "cn", "kr", "hk", "tw", "br", "mx", "za", "il", "ae", "local", "lan",
    "internal", "intranet", "corp", "home", "private", "ad",
]
PRODUCT_TOKENS = ["asp.net", "vb.net", "ado.net", "system.net", "microsoft.net",
                  "asp.net.core"]
SYSTEM_ROOTS = ["windows", "winnt", "program files", "program files (x86)", "programdata",
                "inetpub"]
PUBLIC_IDENTIFIER_PREFIXES = [
    "CVE", "CWE", "CAPEC", "GHSA", "RHSA", "RHBA", "USN", "DSA", "DLA", "ELSA", "ALAS",
    "MFSA", "ADV", "MS", "KB", "CAN", "OVE", "ZDI", "VU", "TALOS", "SUSE", "OPENSSL", "NVD",
    "EPSS", "CVSS", "RFC", "SHA", "AES", "RSA", "TLS", "HTTP", "SMB", "LDAP", "NTLM",
    "ARM64", "X64", "X86", "CD", "DVD", "USB", "PCI", "ISO", "IEC", "FIPS", "UEFI", "ACPI",
    "NVME",
]
INVENTORY_TERMS = [
    "host name", "hostname", "ip address", "ipaddress", "ip_address", "mac address",
    "asset tag", "asset id", "serial number", "serial no", "os version", "last seen",
    "last logon", "last boot", "patch level", "tenant id", "subscription id",
    "resource group", "domain controller", "computer name", "device name", "business unit",
    "site code", "installed version", "agent version", "ou path", "distinguished name",
]
# reserved IPv4 blocks as inclusive ranges of the 32-bit address
RESERVED_IPV4 = [
    ("0.0.0.0", "0.255.255.255"), ("10.0.0.0", "10.255.255.255"),
    ("127.0.0.0", "127.255.255.255"), ("169.254.0.0", "169.254.255.255"),
    ("172.16.0.0", "172.31.255.255"), ("192.0.0.0", "192.0.0.8"),
    ("192.0.0.11", "192.0.0.255"), ("192.0.2.0", "192.0.2.255"),
    ("192.168.0.0", "192.168.255.255"), ("198.18.0.0", "198.19.255.255"),
    ("198.51.100.0", "198.51.100.255"), ("203.0.113.0", "203.0.113.255"),
    ("240.0.0.0", "255.255.255.255"),
]
CONTEXT_WINDOW = 40

# --- text clean-up (fixed values) -----------------------------------------------
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ",
            "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘",
            "rsquo": "’", "ldquo": "“", "rdquo": "”"}
