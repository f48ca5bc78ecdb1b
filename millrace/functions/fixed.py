"""Word lists, patterns, constants and table names whose content decides results.

Patterns are for Java's and RE2's regular expressions alike unless said otherwise, and are meant to be matched without
regard to case (``(?i)``). All of them are defaults of parameters.
"""

from __future__ import annotations

# --- urls -------------------------------------------------------------------------------------------------------

#: Suffixes of two labels under which names are registered; any other last label counts as a suffix of one.
SECOND_LEVEL_SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "ltd.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "org.nz", "net.nz", "co.za",
    "com.br", "com.mx", "com.ar", "com.co", "co.jp", "ne.jp", "or.jp", "co.in", "net.in", "org.in", "com.sg", "com.hk", "co.kr", "com.tr",
    "com.my", "com.ph", "co.id", "co.th", "com.vn", "com.pk", "com.ng", "co.ke", "com.gh", "com.eg", "co.il", "com.ua", "com.pl", "com.tw", "com.cn",
)
#: Hosts under which every customer has a name of their own.
MULTI_TENANT_HOSTS = (
    "mykajabi.com", "kajabi.com", "clickfunnels.com", "myclickfunnels.com", "systeme.io", "wixsite.com", "squarespace.com", "webflow.io",
    "carrd.co", "github.io", "netlify.app", "vercel.app", "godaddysites.com", "weebly.com", "wordpress.com", "blogspot.com", "teachable.com",
    "thinkific.com", "podia.com", "leadpages.co", "leadpages.net", "lpages.co", "kartra.com", "samcart.com", "thrivecart.com", "gumroad.com",
    "stanstore.com", "stan.store", "linktr.ee", "beacons.ai", "hubspotpagebuilder.com", "mailchimpsites.com", "unbounce.com", "instapage.com",
    "typeform.com", "convertkit.com", "kit.com", "gohighlevel.com", "msgsndr.com", "funnelish.com", "groovepages.com", "mystrikingly.com",
    "framer.app", "framer.website", "notion.site", "super.site", "launchpass.com", "simplero.com",
)
#: Host and network, in order of precedence.
SOCIAL_HOSTS = (
    ("facebook.com", "facebook"), ("fb.com", "facebook"), ("instagram.com", "instagram"), ("linkedin.com", "linkedin"), ("twitter.com", "twitter"), ("x.com", "twitter"),
    ("youtube.com", "youtube"), ("youtu.be", "youtube"), ("tiktok.com", "tiktok"), ("pinterest.com", "pinterest"), ("threads.net", "threads"), ("vimeo.com", "vimeo"),
)
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "ref", "referrer", "mc_cid", "mc_eid", "_ga", "yclid", "igshid", "si", "source")
#: A short default; a full block list is a table passed as a parameter.
BLOCKED_DOMAINS = (
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.com", "reddit.com", "vimeo.com", "quora.com", "medium.com",
    "substack.com", "clutch.co", "upwork.com", "fiverr.com", "g2.com", "capterra.com", "trustpilot.com", "yelp.com", "crunchbase.com", "glassdoor.com", "indeed.com",
    "wikipedia.org", "forbes.com", "entrepreneur.com", "inc.com", "nytimes.com", "bbc.com", "cnn.com", "yahoo.com", "google.com", "bing.com", "duckduckgo.com", "apple.com",
    "microsoft.com", "amazon.com", "shopify.com", "kajabi.com", "clickfunnels.com", "teachable.com", "thinkific.com", "hubspot.com", "mailchimp.com", "wix.com", "squarespace.com",
    "wordpress.org", "webflow.com", "calendly.com", "typeform.com", "udemy.com", "coursera.org", "github.com", "stackoverflow.com", "linktr.ee", "beacons.ai", "stan.store", "archive.org",
)
ASSET = r"(?i)\.(?:jpe?g|png|gif|webp|svg|ico|css|js|mjs|json|xml|pdf|zip|rar|7z|gz|mp4|mp3|wav|mov|avi|woff2?|ttf|eot|otf|csv|xlsx?|docx?|pptx?)(?:[?#].*)?$"
SKIPPED_PATH = (
    r"(?i)(/wp-admin|/wp-login|/cart|/checkout|/account|/login|/signin|/sign-in|/register|/privacy|/terms|/cookie|/legal|/disclaimer|/feed|/rss|/tag/|/tags/|/category/|/categories/|/author/|/page/\d|/search|"
    r"/sitemap|/\d{4}/\d{2}/|/thank[-_]?you|/confirm|/unsubscribe|/download|/attachment|/wp-json|/xmlrpc|/cdn-cgi|\.(php|asp|aspx|jsp)\?|/#)"
)
#: Kind, priority, pattern of the path, pattern of the anchor.
PAGE_KINDS = (
    ("case_studies", 1, r"(case[-_]?stud|success[-_]?stor|client[-_]?(stor|result|win|success)|results|wins|proof|testimonial|review|portfolio|our[-_]?work|/work\b|projects?)", r"(case stud|success stor|results|testimonial|client (stor|result|win|success)|portfolio|our work|proof|reviews)"),
    ("clients", 1, r"(/clients?|/customers?|/partners?|/brands)", r"(^clients?$|our clients|who we work with|clients we|customers)"),
    ("about", 2, r"(/about|/our[-_]?story|/who[-_]?we[-_]?are|/team|/company|/mission|/meet)", r"(^about|about us|our story|who we are|meet the team|our team|the team)"),
    ("contact", 2, r"(/contact|/get[-_]?in[-_]?touch|/reach|/book|/apply|/schedule|/call|/consult|/start|/get[-_]?started|/work[-_]?with)", r"(contact|get in touch|book a call|apply|schedule|let.s talk|work with us|get started|free consult|strategy session)"),
    ("services", 3, r"(/services?|/what[-_]?we[-_]?do|/solutions?|/offers?|/ads|/funnels?|/marketing|/paid|/media|/growth|/pricing|/packages|/how[-_]?it[-_]?works)", r"(services|what we do|solutions|how it works|pricing|packages|our process)"),
    ("industries", 2, r"(/industr|/niche|/coach|/course|/creator|/expert|/consultant|/info|/who[-_]?we[-_]?(help|serve))", r"(industries|niches|for coaches|for course creators|who we (help|serve)|coaches|course creators|experts)"),
    ("blog", 5, r"(/blog|/news|/insights|/articles|/resources|/podcast)", r"(^blog$|news|insights|articles|resources|podcast)"),
)
#: Pages of each kind that a crawl takes.
KIND_CAPS = {"case_studies": 6, "clients": 2, "about": 2, "contact": 2, "services": 2, "industries": 2, "blog": 1, "other": 2}
ADMISSION_PREFIX = r"(?i)^(mail|cdn|app|api|help|support|docs|blog|shop|store|login|status)\."

# --- contacts -----------------------------------------------------------------------------------------------------

EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}"
BAD_EMAIL_PARTS = (
    "example.", "sentry.", "wixpress", "yourdomain", "domain.com", "email.com", "@email", "noreply", "no-reply", "donotreply", "@2x", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".webp",
    "@site.", "@company.", "user@", "name@", "john@doe", "test@", "@test.", "@godaddy", "@wordpress", "@wix.com", "@squarespace", "@shopify", "@hubspot", "@mailchimp", "@google.com",
    "@facebook.com", "@apple.com", "@microsoft", "@amazon", "privacy@", "abuse@", "dmca@", "legal@", "@latofonts", "@w3.org", "@schema.org", "you@", "your@", "email@", "someone@", "me@",
    "@mail.com", "@placeholder", "jane@", "@acme.", "@xyz.", "@abc.",
)
KNOWN_TLDS = (
    "com", "net", "org", "io", "co", "ai", "me", "app", "dev", "agency", "marketing", "media", "digital", "studio", "info", "biz", "us", "uk", "ca", "au",
    "nz", "ie", "de", "fr", "es", "it", "nl", "be", "ch", "at", "se", "no", "dk", "fi", "pl", "pt", "br", "mx", "ar", "cl", "za", "in", "sg", "hk", "jp",
    "kr", "ae", "il", "tv", "cc", "xyz", "online", "site", "club", "live", "pro", "group", "team", "global", "world", "email", "consulting", "coach",
    "academy", "education", "expert", "guru", "ltd", "llc", "inc", "eu", "ph", "my", "id", "th", "vn", "pk", "ng", "ke", "gh", "eg", "ma", "tr", "ru", "ua",
    "cz", "ro", "hu", "gr", "sk", "si", "hr", "bg", "lt", "lv", "ee", "is", "lu", "mt", "cy", "cloud", "systems", "solutions", "services", "network",
    "partners", "ventures", "capital", "fund",
)
ASSET_TLDS = ("png", "jpg", "jpeg", "gif", "svg", "webp", "css", "js", "html", "pdf", "min")
ROLE_LOCALS = ("hello", "hi", "hey", "info", "contact", "team", "support", "sales", "partnerships", "inquiries", "enquiries", "admin", "office", "marketing", "growth", "media", "press", "careers", "jobs", "billing", "accounts", "help")
LOW_VALUE_LOCALS = ("careers", "jobs", "billing", "accounts", "help", "support", "press", "privacy", "unsubscribe", "newsletter", "security", "webmaster", "postmaster", "hostmaster")
FREEMAIL = ("gmail.com", "outlook.com", "hotmail.com", "yahoo.com", "icloud.com", "protonmail.com", "me.com")
AT_MARK = r"(?:\[\s*at\s*\]|\(\s*at\s*\)|\{\s*at\s*\}|<\s*at\s*>|\[@\]|\(@\)|&#64;)"
DOT_MARK = r"(?:\[\s*dot\s*\]|\(\s*dot\s*\)|\{\s*dot\s*\}|<\s*dot\s*>)"
PHONE = r"(?:\+\d{1,3}[\s.-]?)?\(?\d{2,4}\)?[\s.-]?\d{3,4}[\s.-]?\d{3,4}(?:[\s.-]?\d{2,4})?"
BOOKING_HOST = r"(calendly\.com|acuityscheduling\.com|hubspot\.com/meetings|meetings\.hubspot|savvycal|tidycal|oncehub|zcal\.co|cal\.com/)"
BOOKING_PATH = r"/(book|apply|schedule|call|consult|strategy|discovery|get-started|start|contact|work-with)"
BOOKING_ANCHOR = r"(book|apply|schedule|call|strategy session|consult|get started|talk)"
SOCIAL_REJECT = r"(sharer|share\?|/share/|intent/|/dialog/|plugins/|/embed|/widgets|/hashtag/|/search\?|/policies|/legal|/help|/privacy|/login|/signup|/explore)"

# --- lexicons -----------------------------------------------------------------------------------------------------

#: Label and pattern, in lexicon order.
SERVICES = (
    ("meta ads", r"\b(facebook|fb|meta|instagram|ig) ads?\b|\bmeta advertising\b|\bfacebook advertising\b|\bpaid social\b"),
    ("google ads", r"\bgoogle ads?\b|\badwords\b|\bsearch ads\b|\bppc\b|\bpay[- ]per[- ]click\b"),
    ("youtube ads", r"\byoutube ads?\b|\byoutube advertising\b|\bvideo ads\b"),
    ("tiktok ads", r"\btiktok ads?\b|\btik ?tok advertising\b"),
    ("paid ads", r"\bpaid (ads|advertising|traffic|media|acquisition|campaigns?)\b|\bmedia buy(ing|er)\b|\bad spend\b|\broas\b|\bcpa\b|\bcost per (lead|acquisition)\b"),
    ("funnels", r"\bfunnels?\b|\bsales funnel\b|\bfunnel (build|design|strateg)|\bwebinar funnel\b|\bvsl\b|\blanding pages?\b"),
    ("lead generation", r"\blead gen(eration)?\b|\bbooked calls?\b|\bappointments? (booked|setting)\b|\bqualified leads\b|\bbook(ed)? (strategy|discovery|sales) calls\b"),
    ("launches", r"\b(course|product|program|digital) launch(es)?\b|\blaunch (strategy|marketing|campaign)\b|\bevergreen\b"),
    ("email marketing", r"\bemail marketing\b|\bemail (sequences?|automation|campaigns)\b|\bnurture sequence\b"),
    ("cro", r"\bconversion rate optimi[sz]ation\b|\bcro\b|\bsplit[- ]test|\ba/b test"),
    ("growth marketing", r"\bgrowth (marketing|partner|agency)\b|\bperformance marketing\b|\bcustomer acquisition\b|\bscal(e|ing) (your|their|our) (business|coaching|offer|program)"),
    ("organic content", r"\borganic (growth|content|marketing)\b|\bcontent marketing\b|\bshort[- ]form (video|content)\b"),
    ("seo", r"\bseo\b|\bsearch engine optimi[sz]ation\b"),
    ("appointment setting", r"\bappointment sett(ing|ers?)\b|\bdm setting\b|\bsetters?\b|\bclosers?\b|\bsales team\b"),
    ("copywriting", r"\bcopywriting\b|\bdirect response\b"),
    ("ghl / automation", r"\bgo ?high ?level\b|\bghl\b|\bmarketing automation\b|\bcrm (setup|build)"),
)
ACQUISITION = ("meta ads", "google ads", "youtube ads", "tiktok ads", "paid ads", "funnels", "lead generation", "launches", "growth marketing", "appointment setting")
ICP = (
    ("coaches", r"\bcoach(es|ing)?\b|\bcoaching (business|industry|clients?|offers?|programs?)\b"),
    ("course creators", r"\bcourse creators?\b|\bonline courses?\b|\bdigital courses?\b|\bcourse (launch|business|sales)\b|\be-?learning\b"),
    ("infopreneurs", r"\binfo ?preneurs?\b|\binfo[- ]?products?\b|\binformation products?\b|\bknowledge (business|entrepreneurs?|commerce)\b|\bedupreneurs?\b|\bdigital products?\b|\beducation business(es)?\b|\bonline education\b"),
    ("consultants", r"\bconsultants?\b|\bconsulting (business|firm|offer)\b"),
    ("high ticket", r"\bhigh[- ]ticket\b|\bpremium (offer|program)s?\b|\b\$\d{1,2}k (offers?|programs?|clients?)\b"),
    ("memberships", r"\bmemberships?\b|\bmembership sites?\b|\bcommunit(y|ies)\b|\bmasterminds?\b"),
    ("personal brands", r"\bpersonal brands?\b|\bthought leaders?\b|\bcreators?\b|\binfluencers?\b|\bexperts?\b|\bauthors?\b|\bspeakers?\b"),
    ("webinars", r"\bwebinars?\b|\bmasterclass(es)?\b|\bchallenges?\b|\bworkshops?\b|\bevergreen webinar\b|\bvsl\b"),
    ("platforms", r"\bkajabi\b|\bclickfunnels\b|\bteachable\b|\bthinkific\b|\bkartra\b|\bgo ?high ?level\b|\bsysteme\.io\b|\bskool\b|\bpodia\b|\bcircle\.so\b|\bmighty networks\b|\bsamcart\b|\bthrivecart\b"),
)
CORE_ICP = ("coaches", "course creators", "infopreneurs", "high ticket", "memberships", "webinars")
AGENCY_SIGNALS = (
    r"\bagency\b", r"\bour (clients|team|services|work|process|case studies)\b", r"\bwe (help|work with|partner with|scale|generate|build|manage|run)\b", r"\bdone[- ]for[- ]you\b",
    r"\bbook (a|your) (call|demo|strategy session|free consultation)\b", r"\bapply (now|to work with us)\b", r"\bcase stud(y|ies)\b", r"\bclient (results|success|stories|testimonials|wins)\b",
    r"\bmanaged (ad|campaigns?)\b", r"\bresults\b",
)
NON_AGENCY = (
    ("saas", r"\b(start (your )?free trial|pricing plans?|per month|/mo\b|sign up free|free plan)\b"),
    ("job_board", r"\b(apply for this job|job description|open positions|careers at)\b"),
    ("listicle", r"\b(top|best) \d+ (marketing |ads? |facebook ads? )?agenc(y|ies)\b"),
    ("directory", r"\b(we are a directory|agency directory|find an agency|compare agencies)\b"),
    ("course_platform", r"\b(enroll now|join the course|course curriculum|modules? \d|lesson \d)\b"),
)
PARKED = (
    r"(?i)(domain (is )?for sale|buy this domain|this domain may be for sale|parked (free )?courtesy|sedo\.com|dan\.com|afternic|hugedomains|godaddy\.com/forsale|namecheap\.com/domains|is parked|coming soon|"
    r"under construction|website is being built|account suspended|this site can.t be reached|default web page|apache2 (debian|ubuntu) default|welcome to nginx|index of /|site not found|no longer available|has expired|"
    r"renew(al)? (now|your domain)|wix\.com/.*premium|this website is temporarily unavailable|website expired|hosting account)"
)
PARKING_HOSTS = r"(?i)(sedo|dan\.com|afternic|hugedomains|godaddy|namecheap|parkingcrew|bodis|above\.com|undeveloped|squadhelp|brandbucket|domainmarket|uniregistry)"
#: Label and pattern on raw html, in lexicon order.
TECH = (
    ("clickfunnels", r"clickfunnels\.com|cf2\.?pages|data-cf-|myclickfunnels|cfcdn\.com|id=\"cf-"), ("kajabi", r"kajabi"), ("gohighlevel", r"leadconnectorhq\.com|msgsndr\.com|gohighlevel|stcdn\.leadconnectorhq|funnel-preview"),
    ("kartra", r"kartra\.com|app\.kartra|kartra-"), ("leadpages", r"leadpages|lpages\.co"), ("systeme.io", r"systeme\.io|systeme-io"), ("webflow", r"webflow\.com|data-wf-|webflow\.js"),
    ("wordpress", r"wp-content|wp-includes|wp-json"), ("elementor", r"elementor"), ("squarespace", r"squarespace"), ("wix", r"wix\.com|wixstatic|wix-code"), ("hubspot", r"hs-scripts\.com|hubspot|hsforms"),
    ("unbounce", r"unbounce"), ("instapage", r"instapage"), ("teachable", r"teachable\.com|teachablecdn"), ("thinkific", r"thinkific"), ("podia", r"podia\.com"), ("samcart", r"samcart"), ("thrivecart", r"thrivecart"),
    ("stripe", r"js\.stripe\.com|checkout\.stripe"), ("calendly", r"calendly\.com"), ("acuity", r"acuityscheduling|squarespace\.com/scheduling"), ("typeform", r"typeform\.com"), ("convertkit", r"convertkit|kit\.com/forms|ck\.page"),
    ("activecampaign", r"activehosted\.com|activecampaign"), ("mailchimp", r"list-manage\.com|mailchimp"), ("klaviyo", r"klaviyo"), ("manychat", r"manychat"), ("wistia", r"wistia"), ("vimeo", r"player\.vimeo\.com"), ("vidalytics", r"vidalytics"),
    ("meta pixel", r"connect\.facebook\.net|fbq\(\s*['\"]init"), ("google ads tag", r"googleads\.g\.doubleclick|gtag\(\s*['\"]config['\"]\s*,\s*['\"]AW-"), ("tiktok pixel", r"analytics\.tiktok\.com"), ("hotjar", r"hotjar"),
    ("intercom", r"intercom"), ("drift", r"drift\.com"), ("hyros", r"hyros"), ("wicked reports", r"wickedreports"), ("funnelish", r"funnelish"), ("groovefunnels", r"groove(pages|funnels|\.cm)"), ("skool", r"skool\.com"),
    ("circle", r"circle\.so"), ("mighty networks", r"mn\.co|mightynetworks"), ("stan store", r"stan\.store"), ("framer", r"framer\.com|framerusercontent"), ("shopify", r"cdn\.shopify\.com"),
)
#: In order of preference.
FUNNEL_PLATFORMS = ("clickfunnels", "kajabi", "gohighlevel", "kartra", "systeme.io", "leadpages", "funnelish", "groovefunnels", "unbounce", "instapage", "samcart", "thrivecart", "teachable", "thinkific", "podia", "stan store", "skool", "hubspot", "webflow", "framer", "elementor", "wordpress", "squarespace", "wix")
FUNNEL_TYPES = (
    ("webinar", r"\bwebinar|\bmasterclass|\bfree training|\btraining\b|\bworkshop|\bregister\b|\bsave (my|your) seat|\bon[- ]demand|\bwatch now"),
    ("vsl", r"\bvsl\b|\bvideo sales|\bwatch (the|this) (free )?video|\bcase[- ]study video"),
    ("application", r"\bapply\b|\bapplication|\bbook (a|your|my) (call|session|consult)|\bstrategy (call|session)|\bschedule (a|your) call|\bdiscovery call|\bclarity call|\bfree consult|\bcalendly\.com|\bbreakthrough (call|session)|\bget started"),
    ("lead_magnet", r"\bfree (guide|ebook|e-book|checklist|template|pdf|download|cheat ?sheet|toolkit|blueprint|playbook|workbook|report|gift)|\bdownload\b|\bopt[- ]?in|\bfreebie|\bgrab (the|your) free"),
    ("challenge", r"\b\d+[- ]day challenge|\bchallenge\b|\bbootcamp"),
    ("quiz", r"\bquiz\b|\bassessment\b|\bscorecard\b|\btake the (test|quiz)"),
    ("low_ticket", r"\b\$\d{1,2}(\.\d\d)?\b|\btripwire|\bmini[- ]course|\bworkshop replay|\bbundle\b|\bself[- ]paced"),
    ("course_sales", r"\benroll|\bjoin (the|now|today)\b|\bcourse\b|\bacademy\b|\bprogram\b|\bmembership\b|\bmastermind|\bcertification|\bdoors (are )?(open|closing)|\bwaitlist"),
    ("book_funnel", r"\bfree (\+ shipping|book)|\bget (the|my|your) book|\bbook funnel"),
    ("newsletter", r"\bnewsletter|\bsubscribe\b|\bjoin \d+[,.]?\d* (subscribers|readers)"),
    ("community", r"\bskool\.com|\bcircle\.so|\bfacebook\.com/groups|\bjoin (the|our) (free )?(community|group)"),
    ("link_in_bio", r"linktr\.ee|beacons\.ai|stan\.store|bio\.link|linkin\.bio"),
)
FUNNEL_PATH = r"(?i)(webinar|masterclass|training|workshop|register|apply|application|book|call|schedule|consult|free|guide|download|optin|opt-in|challenge|quiz|assessment|enroll|join|program|course|academy|mastermind|membership|offer|special|vsl|watch|start|waitlist|bootcamp|coaching|work-with|workwith)"
FUNNEL_HOSTS = (
    r"(?i)(clickfunnels\.com|mykajabi\.com|kajabi\.com|systeme\.io|leadpages\.(co|net)|lpages\.co|kartra\.com|gohighlevel\.com|msgsndr\.com|funnelish\.com|groovepages\.com|samcart\.com|thrivecart\.com|teachable\.com|"
    r"thinkific\.com|podia\.com|stan\.store|skool\.com|calendly\.com|acuityscheduling\.com|typeform\.com|ck\.page|convertkit\.com|kit\.com|webinarjam\.com|everwebinar\.com|demio\.com|zoom\.us/webinar|hubspotpagebuilder|"
    r"instapage\.com|unbounce\.com|carrd\.co|linktr\.ee|beacons\.ai)"
)
PRICE = r"(?i)(\$|€|£)\s?\d{1,3}(?:[,.]\d{3})*(?:\.\d{2})?(?:\s?(k|/mo|/month|per month))?"
LISTICLE_TITLE = (
    r"(?i)(\b(top|best|leading)\s+(\d{1,3}\s+)?(?:[\w&'-]+\s+){0,6}(agencies|companies|firms|partners|experts|freelancers|consultants|providers)\b)|(\b\d{1,3}\s+(?:best|top|leading)?\s*(?:[\w&'-]+\s+){0,6}"
    r"(agencies|companies|firms|partners|experts)\b(?:\s+(for|to|that|in|you)\b)?)|(\b(agencies|companies|firms)\s+(to (hire|work with|watch|consider)|for (coaches|course creators|consultants|experts|creators|info ?products|online courses|coaching))\b)"
)
LISTICLE_CONTEXT = r"(?i)\b(marketing|ads?|advertising|funnel|lead|growth|digital|coach|course|ppc|media|social|seo|creative|launch)\b"
LISTICLE_URL = r"(?i)/(top|best)-\d*-?[a-z-]*(agenc|compan|firm)"
ROLE_WORDS = (
    "business coach", "life coach", "executive coach", "mindset coach", "health coach", "fitness coach", "wellness coach", "relationship coach", "dating coach", "career coach", "leadership coach", "money coach",
    "financial coach", "sales coach", "marketing coach", "real estate coach", "trading coach", "trading educator", "forex educator", "ecommerce coach", "amazon fba coach", "spiritual coach", "transformational coach",
    "confidence coach", "parenting coach", "nutrition coach", "performance coach", "productivity coach", "public speaking coach", "online coach", "course creator", "online course creator", "infopreneur",
    "digital course creator", "online educator", "educator", "consultant", "mentor", "trainer", "author", "speaker", "founder of", "creator of", "ceo of", "host of", "coach",
)
CLIENT_CONTEXT = (
    r"(?i)\b(client|clients|case stud(y|ies)|testimonial|results?|success stor(y|ies)|we helped|helped|worked with|working with|partnered with|scaled|generated|grew|took|brought|launched|from \$|to \$|roas|revenue|in sales|"
    r"per month|in \d+ days|booked calls|leads)\b"
)
MONEY_RESULT = r"(?i)(\$|€|£)\s?\d[\d,.]*\s?(k|m|million|thousand)?\b|\b\d+(\.\d+)?x\s?(roas|return)\b|\b\d{2,3}%\b"
#: Words that a query's significant terms leave out.
QUERY_STOP = (
    "the", "a", "an", "and", "or", "for", "of", "to", "in", "on", "with", "by", "at", "from", "is", "are", "we", "our", "your", "you", "that", "this", "it",
    "as", "be", "do", "how", "what", "who", "best", "top", "vs", "near", "me", "my", "us", "site", "linkedin", "com", "www", "http", "https", "agency",
    "agencies", "marketing", "ads", "ad", "online", "digital", "services", "company", "business",
)
#: Verdicts of mail checks that don't count as an address.
DEAD_VERIFICATIONS = ("invalid", "no_mx")

# --- thresholds ---------------------------------------------------------------------------------------------------

MIN_SCORE = 55
ENGLISH_CONFIDENCE = 0.75
DEGRADED_RELEVANCE = 0.25
COOLDOWN_SECONDS, MAX_FAILURES = 900, 4

# --- company --------------------------------------------------------------------------------------------------------

#: End of the domain and country, in order of precedence.
COUNTRY_TLD = (
    (".co.uk", "United Kingdom"), (".uk", "United Kingdom"), (".com.au", "Australia"), (".au", "Australia"), (".ca", "Canada"), (".ie", "Ireland"), (".nz", "New Zealand"), (".sg", "Singapore"), (".co.za", "South Africa"),
    (".in", "India"), (".ae", "United Arab Emirates"), (".us", "United States"), (".de", "Germany"), (".fr", "France"), (".es", "Spain"), (".nl", "Netherlands"), (".ph", "Philippines"), (".pk", "Pakistan"),
)
COUNTRY_WORDS = (
    ("united states", "United States"), ("usa", "United States"), ("u.s.", "United States"), ("america", "United States"), ("united kingdom", "United Kingdom"), ("uk", "United Kingdom"), ("england", "United Kingdom"),
    ("scotland", "United Kingdom"), ("wales", "United Kingdom"), ("australia", "Australia"), ("canada", "Canada"), ("ireland", "Ireland"), ("new zealand", "New Zealand"), ("singapore", "Singapore"), ("south africa", "South Africa"),
    ("dubai", "United Arab Emirates"), ("uae", "United Arab Emirates"), ("india", "India"), ("philippines", "Philippines"), ("germany", "Germany"), ("netherlands", "Netherlands"), ("spain", "Spain"), ("portugal", "Portugal"),
    ("france", "France"), ("israel", "Israel"), ("pakistan", "Pakistan"), ("nigeria", "Nigeria"), ("malaysia", "Malaysia"), ("mexico", "Mexico"), ("brazil", "Brazil"), ("bali", "Indonesia"), ("thailand", "Thailand"),
)
#: Country and its cities, in order of precedence.
CITIES = (
    ("United States", "new york|nyc|los angeles|miami|austin|san diego|san francisco|chicago|dallas|houston|denver|phoenix|scottsdale|atlanta|nashville|boston|seattle|las vegas|orlando|tampa|charlotte|salt lake city|boise|portland|philadelphia"),
    ("United Kingdom", "london|manchester|birmingham|bristol|leeds|edinburgh|glasgow"), ("Australia", "sydney|melbourne|brisbane|perth|gold coast|adelaide"), ("Canada", "toronto|vancouver|montreal|calgary|ottawa"),
    ("Ireland", "dublin"), ("New Zealand", "auckland|wellington"), ("South Africa", "cape town|johannesburg"), ("Portugal", "lisbon"), ("Spain", "barcelona"), ("Germany", "berlin"), ("Netherlands", "amsterdam"), ("Israel", "tel aviv"), ("Indonesia", "bali"),
)
US_ADDRESS = r"\b([A-Z][a-zA-Z .]{2,30}),\s*(AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY)\b\.?\s*\d{5}?"
AU_ADDRESS, UK_POSTCODE, CA_POSTCODE = r"\b(NSW|VIC|QLD|WA|SA|TAS|ACT|NT)\s+\d{4}\b", r"\b[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}\b", r"\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b"
BASED_IN = r"(?i)\b(?:based|located|headquartered|hq|offices?|we are|we're|team)\s+(?:in|out of|from)\s+((?-i:[A-Z][a-zA-Z]+(?:\s[A-Z][a-zA-Z]+){0,2}))"
FOUNDED = r"(?i)\b(?:founded|established|since|started|launched)\s+(?:in\s+)?(19[89]\d|20[0-4]\d)\b"
TEAM_SIZE = r"(?i)\b(?:team of|over|more than|with)\s+(\d{1,4})\+?\s+(?:people|team members|employees|specialists|experts|marketers|media buyers|staff)\b"
SIZE_WORDS = r"(?i)\b(boutique|small team|solo|one[- ]person|freelance|freelancer|we are a (small|lean|tight-knit) team|just me)\b"
COPYRIGHT = r"(?i)(?:©|&copy;|copyright)\s*(?:\d{4}\s*[-–]\s*)?(20[0-4]\d)"
ORG_TYPES = ("organization", "localbusiness", "corporation", "marketingagency", "professionalservice", "advertisingagency")

# --- people ---------------------------------------------------------------------------------------------------------

FOUNDER_TITLE = r"(?i)\b(co-?founder|founder|ceo|owner|managing director|managing partner|president|principal|director|chief executive)\b"
#: Keyword and niche, the first that occurs decides.
NICHES = (
    ("business coach", "business coaching"), ("life coach", "life coaching"), ("fitness", "fitness"), ("health", "health & wellness"), ("wellness", "health & wellness"), ("nutrition", "nutrition"), ("mindset", "mindset"),
    ("relationship", "relationships"), ("dating", "dating"), ("real estate", "real estate"), ("trading", "trading & investing"), ("forex", "trading & investing"), ("crypto", "trading & investing"), ("ecommerce", "ecommerce education"),
    ("amazon", "ecommerce education"), ("financial", "finance"), ("money", "finance"), ("career", "career"), ("leadership", "leadership"), ("executive", "executive coaching"), ("spiritual", "spirituality"), ("yoga", "yoga"),
    ("parenting", "parenting"), ("marketing", "marketing education"), ("sales", "sales training"), ("author", "author / publishing"), ("speaker", "speaking"), ("course", "online courses"), ("coach", "coaching"), ("consult", "consulting"),
)
#: A short default of words that no person's name has; a longer list is a parameter.
COMMON_WORDS = (
    "about", "account", "ads", "agency", "all", "apply", "best", "blog", "book", "brand", "business", "call", "case", "clients", "coach", "coaching",
    "company", "contact", "content", "course", "create", "customer", "digital", "email", "free", "funnel", "get", "growth", "guide", "help", "home", "how",
    "launch", "lead", "leads", "learn", "marketing", "media", "meet", "more", "new", "news", "online", "our", "page", "partner", "paid", "policy", "privacy",
    "program", "results", "sales", "service", "services", "social", "start", "story", "strategy", "study", "success", "support", "system", "team", "terms",
    "testimonials", "the", "training", "video", "web", "website", "week", "work", "your",
)
NAME_STOP = (
    "facebook", "instagram", "google", "youtube", "tiktok", "linkedin", "meta", "kajabi", "clickfunnels", "teachable", "thinkific", "podia", "kartra",
    "gohighlevel", "calendly", "zoom", "shopify", "amazon", "apple", "microsoft", "hubspot", "mailchimp", "stripe", "paypal", "wordpress", "webflow",
    "squarespace", "wix", "forbes", "entrepreneur", "inc", "home", "services", "blog", "faq", "login", "monday", "tuesday", "wednesday", "thursday", "friday",
    "saturday", "sunday", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december", "ceo",
    "founder", "coach", "marketing", "ads",
)
#: Wait after a block, and places in a search that count.
GUESSED_LOCALS = ("hello", "info", "contact", "team", "hi")
EXPORT_COLUMNS = (
    "tier", "score", "status", "agency_name", "website", "domain", "email", "email_verification", "email_source", "all_emails", "founder_name",
    "founder_title", "founder_linkedin", "founder_source", "linkedin_company", "instagram", "facebook", "youtube", "country", "city", "services",
    "icp_signals", "tech", "booking_url", "phone", "last_activity", "client_name", "client_role", "client_niche", "client_website", "client_evidence",
    "client_evidence_url", "clients_count", "funnel_url", "funnel_type", "funnel_platform", "funnel_offer", "funnel_price", "funnel_steps", "tagline",
    "description", "pages_crawled", "key_pages", "reject_reason",
)

# --- words for people and sites -------------------------------------------------------------------------------------
# What counts as such a word decides results. Patterns are composed from them where they are used.

FOUNDER_NOUNS = ("founder", "co-founder", "cofounder", "ceo", "owner", "managing director")
FOUNDING_VERBS = ("founded", "started", "created", "launched", "run", "led", "owned")
#: Words before a name that are no part of it, whatever their case.
NAME_LEADS = ("meet", "the", "hi", "hey", "hello", "our", "i", "we", "and", "by", "with", "from", "for", "client", "dr", "mr", "mrs", "ms", "prof")
#: What introduces a client in a heading, and what a heading tells of as a result.
HEADING_LEADS = ("how", "how we helped", "helped", "helping", "case study", "client", "client spotlight", "success story", "working with", "results for", "meet")
RESULT_WORDS = ("$", "€", "£", "%", "x", "roas", "leads", "calls", "clients", "students", "launch")
#: Classes and ids of blocks that quote clients or tell of them; descendants that name the speaker; sections of logos, their headings, and the press.
BLOCK_CLASSES = ("testimonial", "review", "quote", "case-stud", "casestud", "client", "success", "result", "story", "feedback")
CITE_TAGS = ("cite", "figcaption", "h3", "h4", "h5", "strong", "b")
CITE_CLASSES = ("author", "name", "title")
LOGO_CLASSES = ("client", "logo", "trusted", "featured", "partner", "brand", "worked", "as-seen", "seen-on", "portfolio")
LOGO_HEADINGS = ("client", "trusted by", "worked with", "work with", "partner", "brands we", "brands that", "brands who", "companies we", "companies that", "companies who", "loved by", "used by", "our customers", "success stories")
HANDLE_NOISE = ("the", "official", "real", "iam", "im", "coach", "mr", "mrs", "ms", "dr", "its", "hey", "hi", "team", "agency", "marketing", "page", "tv", "hq", "co", "inc")
#: Words of a name that don't tell it, and domains that are no client's.
NAME_FILLERS = ("dr", "mr", "mrs", "ms", "the", "and", "of")
NOT_CLIENT_DOMAIN = r"(dictionary|thesaurus|wiki|news|times|post|tribune|herald|journal|daily|gazette|video|tube|movie|film|college|university|\.edu$|\.gov$|godaddy|wix\.com|squarespace\.com|amazon|ebay|etsy|imdb|spotify|apple\.com|google|yahoo|bing|parenting|recipe|weather|sports|hospital|clinic|pharma|bank|insurance)"
#: Tags whose start ends an open paragraph.
ENDS_PARAGRAPH = ("address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul")
GREETINGS = ("hi", "hey", "hello")
STORY_WORDS = ("founder", "ceo", "owner", "started", "built", "run")
SELF_WORDS = ("i'm", "im", "i am", "my name is")
TEAM_ROLES = ("founder", "co-founder", "ceo", "owner", "director", "head of", "managing", "chief", "partner", "lead", "strategist", "media buyer", "account manager", "team")
#: Around a name with a team role they tell that the person is a client.
CLIENT_WORDS = ("client", "testimonial", "case study", "review")
#: Around a name with a founder's title they tell that it is a client's.
STORY_CONTEXT = ("client", "testimonial", "case study", "review", "helped", "read story", "read the story", "read more", "success stor")
OWN_CONTEXT = ("our founder", "our ceo", "our agency", "our company", "our team", "my founder", "my ceo", "my agency", "my company", "my team")
COMPANY_TITLES = ("co-founder", "cofounder", "founder", "ceo", "owner", "managing director", "president", "director")
PRESS_WORDS = ("as seen on", "as seen in", "featured on", "featured in", "press")
INSTITUTIONS = ("school", "university", "federation", "association", "institute", "college", "foundation", "council")
LOGO_NOISE = ("logo", "client", "brand", "image", "icon", "png", "svg", "jpg")
AGENCY_SUFFIXES = ("agency", "marketing", "media", "digital", "llc", "inc", "ltd", "co", "group")
CASE_PATHS = ("case-stud", "case_stud", "case stud", "casestud", "client", "results", "success", "testimonial", "portfolio", "our-work", "work/", "wins", "stories", "review", "proof", "partner/", "partners/")
#: Titles of linked pages that lead nowhere, and words of lists and of news hosts.
NOISE_ANCHORS = ("read more", "learn more", "visit", "visit website", "visit site", "website", "here", "source", "link", "view profile", "see more")
LIST_WORDS = ("agency", "agencies", "marketing", "ads", "funnel", "growth", "media", "digital", "partners", "studio", "collective", "labs", "consult")
NEWS_WORDS = ("news", "times", "post", "tribune", "herald", "gazette", "journal", "daily", "bee", "press", "wire", "magazine", "reuters", "bloomberg", "cnbc", "wsj", "britannica", "webster", "wikipedia")
#: What a coach of clients, not of sports, speaks of; how a freelancer and a company present themselves.
ONLINE_WORDS = ("online", "digital", "program", "course", "webinar", "funnel", "high ticket", "high-ticket", "highticket", "clients", "calls")
FREELANCE_WORDS = ("freelance", "freelancer", "i'm a media buyer", "im a media buyer", "i'm a marketer", "im a marketer", "i'm a consultant", "im a consultant", "hire me", "my services", "work with me")
COMPANY_WORDS = ("our team", "we are a team", "agency")
OUR_WORDS = ("our clients", "our services", "our team")
#: Words that are no part of a founder's name, and first words that are dropped.
NOT_FOUNDER = ("i'm", "im", "i", "we", "the", "our", "and", "team", "agency", "marketing", "ads", "media", "founder", "ceo", "story", "about", "meet", "hi", "hello")
COMPANY_NAME_WORDS = ("Inc", "LLC", "Ltd", "Agency", "Media", "Marketing", "Digital", "Group", "Co")
#: Paths of a network that are no profile, and paths that are one.
LINKEDIN_PROFILES = ("company", "in", "school", "showcase")
YOUTUBE_OTHERS = ("watch", "embed", "playlist", "shorts", "results")
FACEBOOK_OTHERS = ("groups", "events", "photo", "video", "story", "login", "share", "dialog")
#: Funnel types in order of preference where scores tie.
FUNNEL_TYPE_ORDER = ("webinar", "vsl", "application", "challenge", "quiz", "lead_magnet", "course_sales", "low_ticket", "book_funnel", "community", "newsletter", "link_in_bio")
#: Tags without visible text, tags that break lines, tags without an end, and meta names whose content is a date.
SILENT_TAGS = ("script", "style", "noscript", "svg", "iframe", "canvas", "template", "head", "video", "audio", "picture", "source")
BREAKING_TAGS = (
    "p", "div", "li", "ul", "ol", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "section", "article", "header", "footer", "blockquote", "figcaption", "nav",
    "aside", "main", "form", "pre", "dd", "dt", "dl", "address", "summary", "details", "option", "label", "button",
)
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
DATE_NAMES = ("article:modified_time", "article:published_time", "og:updated_time", "last-modified", "date", "dc.date", "datepublished", "datemodified", "revised")
