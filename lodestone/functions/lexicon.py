"""Word lists, patterns and constants that results depend on. Order matters where the first match wins."""

# Fixed values. One white-space character, in a form that Java and RE2 both read.
WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# Page-quality signals.
SHELL_SIGNALS = ["sign in", "log in", "create account", "forgot your password", "cookie settings", "accept cookies", "privacy policy", "terms of service", "accessibility policy", "equal opportunity employer", "all rights reserved"]
CHALLENGE_SIGNALS = ["just a moment", "verifying you are human", "performing security verification", "verification successful", "enable javascript and cookies to continue", "performance and security by cloudflare", "ray id"]
PORTAL_SIGNALS = ["my jobpage", "my job cart", "my saved searches", "my referrals", "my account options", "this service is set to disconnect automatically", "you have been signed out", "beginning of the main content section", "return to previous position on page", "refer a friend for this job", "submit a candidate's profile"]
BODY_KEYWORDS = ["description", "requirements", "qualifications", "deadline", "responsibilities", "application instructions", "application process", "research", "position", "university", "contact"]
DETAIL_KEYWORDS = ["required qualifications", "preferred qualifications", "brief description of duties", "job description -", "essential duties", "minimum qualifications", "about the role", "application deadline"]
TEMPLATE_PATTERNS = [r"\{\{[^{}]+\}\}", r"\{\$[^{}]+\}", r"\$\{[^{}]+\}"]
PDF_INDICATORS = ["%PDF-", "endobj", "endstream", "/Type", "/Catalog", "Binary data follows", "Font substitution", "Invalid encoding", "/MediaBox", "/Contents", "/XObject", "/ProcSet"]
PDF_MARKERS = ["endobj", "endstream", "/Type", "/Catalog", "/Pages", "/MediaBox", "/Contents", "startxref", "%%EOF", "trailer"]
UNAVAILABLE = ["暂不支持您的浏览器", "推荐您下载", "无法下载", "无法打印", "不支持下载", "不支持打印", "download not supported", "print not supported", "browser not supported", "unsupported browser", "please download", "recommended download", "体验更流畅", "立即下载", "access denied", "access restricted", "content unavailable"]
ERROR_WORDS = ["error", "404", "403", "500", "not found", "forbidden"]

# Markers of comments, page shells and challenges in extracted texts.
COMMENT_MARKERS = ["report this comment", "report this post", "to view or add a comment", "see more comments", "add a comment", "like reply", "reactions", "reaction", "show more replies"]
CUT_MARKERS = ["to view or add a comment", "see more comments", "report this comment"]
BOILERPLATE_MARKERS = ["skip to main content", "sign in", "log in", "join now", "create account", "forgot password", "cookie policy", "cookie settings", "accept cookies", "privacy policy", "terms of service", "user agreement", "all rights reserved", "explore content categories", "toggle navigation", "back to top"]
CHALLENGE_MARKERS = ["just a moment", "verifying you are human", "performing security verification", "enable javascript and cookies to continue", "performance and security by cloudflare"]
UI_LINE = r"(like|reply|comment|share|repost|follow|connect|\p{Nd}+@*(reaction|reactions|comments?|followers?))"
# Trust in a method and its head start.
METHOD_WEIGHTS = {"json-ld": (1.0, 1200.0), "trafilatura": (1.0, 300.0), "resiliparse": (1.0, 300.0), "og:description": (0.9, -200.0), "innerText": (0.40, 0.0), "soup": (0.35, 0.0)}
OTHER_WEIGHT = (0.5, 0.0)
# Our own main-text candidates have the trust of the extractors they stand in for.
METHOD_WEIGHTS |= {"wide_segment": (1.0, 300.0), "tight_segment": (1.0, 300.0)}

# Clean-up.
ENCODING_FIXES = [("\ufeff", ""), ("\xa0", " "), ("\u2013", "-"), ("\u2014", "--"), ("\u201c", '"'), ("\u201d", '"'), ("\u2018", "'"), ("\u2019", "'"), ("\u2026", "...")]
EDITOR_CHROME = [r"File@+Edit@+View@+Tools@+Help", r"Accessibility@+Debug", r"Tab@+External@+Share", r"Sign in", r"JavaScript isn't enabled.*?Enable and reload", r"This browser version is no longer supported.*?upgrade to a supported browser"]
OCR_UI = ["view only", "scroll", "rotate", "edit", "split", "merge", "extract text", "pdf to word", "pdf to image", "ai podcast", "all translate", "adjust page", "file compress", "shortcut tools", "print", "thumbnail", "outline", "zoom in", "zoom out", "next page", "previous page", "download", "share", "annotation", "highlight", "comment", "save", "export", "upload"]
OCR_KEPT = r""".,;:!?()\[\]{}\-—–'"/@#$%&*+=<>"""
DRIVE_PLACEHOLDERS = ["Loading…", "Sign in", "Unable to preview", "Access denied"]
DOCS_PLACEHOLDERS = ["JavaScript isn't enabled", "Enable and reload", "Sign in", "Unable to preview", "Access denied", "This browser version is no longer supported"]

# URLs.
THIRD_PARTY = ["linkedin.com", "twitter.com", "x.com", "zhihu.com", "xiaohongshu.com", "weibo.com", "facebook.com", "instagram.com", "github.com", "weixin.qq.com", "mp.weixin.qq.com", "wechat.com", "findaphd.com", "researchgate.net", "google.com", "medium.com", "scholar.google.com", "phdportal.com", "mastersportal.com", "zhuanlan.zhihu.com"]
EXPORT_FORMATS = ["txt", "pdf", "html", "docx", "rtf", "odt", "epub"]
BLOCKED_URLS = ["bing.com/aclick", "bing.com/ck/", "bing.com/fd/", "googleadservices.com", "doubleclick.net", "pagead", "adclick", "/aclk?", "linkedin.com/jobs", "indeed.com", "glassdoor.com", "monster.com", "ziprecruiter.com", "simplyhired.com", "wikipedia.org", "wikimedia.org", "quora.com", "reddit.com", "stackexchange.com", "stackoverflow.com", "medium.com", "substack.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "tiktok.com", "youtube.com", "weibo.com", "amazon.com", "ebay.com", "alibaba.com", "shopify.com", "bing.com/search", "duckduckgo.com", "duck.com", "msn.com", "google.com/search", "google.com/aclk"]
ALLOWED_URLS = [".edu", ".ac.uk", ".ac.jp", ".ac.cn", ".ac.nz", ".ac.za", ".edu.au", ".edu.cn", ".edu.hk", ".edu.sg", ".edu.tw", "scholar.google", "researchgate.net", "orcid.org", "academia.edu", "semanticscholar.org", "scopus.com", "pubmed.ncbi", "ncbi.nlm", "arxiv.org", "springer.com", "nature.com", "science.org", "ieee.org", "acm.org", "ssrn.com", "linkedin.com/in/", "/people/", "/faculty/", "/staff/", "/profile/", "/researcher/", "/~", "/en/persons/", "/en/researchers/"]
REDIRECT_KEYS = ["uddg", "rut", "u"]
URL_IN_TEXT = r"""https?://[^\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}<>"{}|\\^`\[\]]+"""
ATS_HOSTS = [("myworkdayjobs.com", "workday"), ("greenhouse.io", "greenhouse"), ("lever.co", "lever"), ("ashbyhq.com", "ashby"), ("smartrecruiters.com", "smartrecruiters"), ("recruitee.com", "recruitee"), ("workable.com", "workable"), ("personio.", "personio"), ("bamboohr.com", "bamboohr"), ("teamtailor.com", "teamtailor"), ("eightfold.ai", "eightfold"), ("oraclecloud.com", "oracle_hcm")]
ATS_SIGNATURES = [("workday", ["myworkdayjobs.com", ".myworkday", "/wday/"]), ("greenhouse", ["boards.greenhouse.io", "greenhouse.io/embed", "grnhse", "boards-api.greenhouse"]), ("lever", ["jobs.lever.co", "lever.co/postings", "api.lever.co"]), ("ashby", ["jobs.ashbyhq.com", "ashbyhq"]), ("smartrecruiters", ["smartrecruiters.com"]), ("icims", ["icims.com"]), ("taleo", ["taleo.net"]), ("successfactors", ["successfactors.com", "sfcareer", "jobs.sap.com"]), ("talentlink", ["lumessetalentlink.com", "data-talentlink-fo-", "talentlink"]), ("oraclecloud", ["oraclecloud.com/hcmui", "/hcmui/candidateexperience"])]
HARD_ATS = ["talentlink", "taleo", "successfactors", "oraclecloud"]

# Contacts.
MISSING = ["-", "", "N/A"]
NAME_PREFIXES = ["Dr.", "Prof.", "Professor", "Assistant Professor", "Associate Professor", "Mr.", "Ms.", "Miss", "Mrs.", "Doctor"]
NAME_SUFFIXES = [", Ph.D.", ", PhD", ", Ph.D", ", Professor", ", Prof.", ", Dr."]
GENERIC_LOCALS = ["info", "contact", "admissions", "admission", "admin", "office", "support", "help", "service", "services", "enquiries", "enquiry", "apply", "application", "applications", "jobs", "career", "careers", "hr", "hello", "mail", "kios", "email", "grad"]
BLOCKED_LOCALS = ["info@", "contact@", "admissions@", "webmaster@", "privacy@", "email@"]
PRIORITY_DOMAINS = ["scholar.google", "researchgate.net", "linkedin.com", "orcid.org", "academia.edu", ".edu", ".ac.", ".org"]
PATH_HINTS = ["/people/", "/profile/", "/directory/", "/staff/", "/faculty/", "/person/"]
HOST_HINTS = ["kios.ucy.ac.cy", "ucy.ac.cy"]
SOCIAL_HINTS = ["linkedin.com", "x.com", "twitter.com"]
TITLE_WORDS = ["professor", "dr.", "phd", "faculty", "researcher", "scholar"]
PAGE_WORDS = ["homepage", "profile", "bio", "cv", "resume", "contact", "directory"]
PROFILE_WORDS = ["profile", "profiles", "our team", "team", "member", "people", "lab", "researcher", "assistant professor", "professor", "principal investigator", "department", "faculty", "contact", "email:", "verified email"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# Records and business rules.
STAGE1_FIELDS = ["Deadline", "Number_Places", "Direction", "University_EN", "Contact_Name", "Contact_Email"]
POSITION_TYPES = ["Master Student", "Doctoral Student", "PostDoc", "Research Assistant", "Competition", "Summer School", "Conference", "Workshop"]
EVENT_TYPES = ["Competition", "Summer School", "Conference", "Workshop"]
GEO_FIELDS = ["Physical_Geo", "Human_Geo", "Urban", "GIS", "RS", "GNSS"]
STAGE2_FIELDS = POSITION_TYPES + GEO_FIELDS
STAGE3_FIELDS = ["University_CN", "Country_CN", "WX_Label1", "WX_Label2", "WX_Label3", "WX_Label4", "WX_Label5"]
TRIMMED_FIELDS = ["Deadline", "Direction", "University_EN", "Contact_Name", "Contact_Email", "University_CN", "Country_CN", "WX_Label1", "WX_Label2", "WX_Label3"]
ANSWER_MARKERS = ["最终答案：", "Final Answer:", "答案：", "Answer:", "结果：", "Result:", "输出：", "Output:"]
THIRD_PARTY_NOTE, NOTES_NOTE = "可能是第三方网址", "需转换链接"
NO_ROW, NO_LINK, NO_CONTENT = "无法获取行数据", "未找到有效链接", "内容获取失败"

# Model catalogue.
PLATFORM_PREFIXES = [("OpenAI", ["gpt", "o1", "o3", "o4", "chatgpt", "text-", "dall"]), ("Google", ["gemini"]), ("Anthropic", ["claude"]), ("DeepSeek", ["deepseek"]), ("Moonshot", ["kimi", "moonshot"]), ("Mistral", ["mistral"]), ("Qwen", ["qwen"])]
OTHER_PLATFORM = "其他"
VISION_NAMES = ["gpt-4o", "gpt-4.1", "gpt-5", "o4", "o3", "gemini", "claude", "pixtral", "qwen-vl", "qwen2-vl", "qwen2.5-vl", "llava", "document-ai", "vision", "-vl"]
TEXT_ONLY_NAMES = ["text-embedding", "embedding", "imagen", "gpt-image", "dall-e", "dall"]
BASE_PRICE, BLOCK_SECONDS, AUTH_FAILURES = 2.0, 1800, [401, 403]
