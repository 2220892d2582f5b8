"""Vocabularies that decide results. Every table here holds fixed values."""

from __future__ import annotations


def _words(text: str) -> list[str]:
    return text.split()


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def _aliases(text: str) -> dict[str, str]:
    """Lines of `code: name, name` as name to code; of a name in two lines the later counts."""
    pairs = (line.split(":", 1) for line in text.strip().splitlines())
    return {name: code.strip() for code, names in pairs for name in _names(names)}


# Letters without a decomposition.
LETTER_FOLDS = {"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i", "ħ": "h", "ŋ": "n"}

# Company names.
LEGAL_SUFFIXES = _words("""
    inc incorporated llc lllc llp lp ltd ltda limited plc corp corporation co company gmbh mbh ug ag kg kgaa se bv nv cv
    sa sas sarl sl slu spa srl ab as asa aps oy oyj pty pte kk kft zrt doo sp z oo dmcc fzco fze pvt sdn bhd""")
COMPANY_EDGE_NOISE = _words("remote remotely worldwide anywhere hiring careers career jobs job")
COMPANY_TLDS = _words("com io ai net org so dev app co cloud tech xyz gg tv me")
PLACEHOLDER_COMPANIES = _names("unknown, n a, na, none, null, undefined, confidential, undisclosed, private, anonymous, hidden, company, employer, client, anon")

# Titles.
DECORATION_TOKENS = _words("""
    remote remotely remoto worldwide world wide anywhere global globally hybrid onsite site wfh work from home based
    location friendly only preferred flexible timezone timezones cet est pst gmt utc us usa uk eu gb emea apac latam
    europe america americas canada india germany full part time fulltime parttime contract contracting contractor
    freelance permanent perm temporary temp w2 c2c corp to no 1099 urgent urgently hiring immediate immediately joiner
    joiners apply now open opening position role vacancy any all agencies m f d w x v h mfd mwd fmd mfx mwx gender
    genders divers diverse""")
EDGE_TOKENS = _words("remote remotely worldwide anywhere hybrid onsite wfh urgent urgently hiring fulltime parttime freelance")
PHRASE_RULES = [
    ("front end", "frontend"), ("back end", "backend"), ("full stack", "fullstack"), ("fullstack", "fullstack"), ("dev ops", "devops"),
    ("node js", "nodejs"), ("react js", "react"), ("reactjs", "react"), ("vue js", "vue"), ("vuejs", "vue"), ("next js", "nextjs"),
    ("type script", "typescript"), ("java script", "javascript"), ("sr", "senior"), ("snr", "senior"), ("jr", "junior"), ("jnr", "junior"),
]

# Places, by table.
REMOTE_HINTS = _names("remote, remotely, anywhere, worldwide, world wide, distributed, global, globally, virtual, telecommute, telework, work from home, wfh, home based, no office")
COUNTRIES = _aliases("""
    us: usa, us, u s, u s a, united states, united states of america
    uk: uk, united kingdom, great britain, britain, england, scotland, wales, northern ireland
    ca: canada
    de: germany, deutschland
    fr: france
    es: spain, espana
    pt: portugal
    nl: netherlands, the netherlands, holland
    be: belgium
    ch: switzerland
    at: austria
    it: italy
    ie: ireland
    pl: poland, polska
    cz: czechia, czech republic
    sk: slovakia
    si: slovenia
    hr: croatia
    rs: serbia
    ro: romania
    bg: bulgaria
    gr: greece
    hu: hungary
    ua: ukraine
    ru: russia
    se: sweden
    no: norway
    dk: denmark
    fi: finland
    ee: estonia
    lv: latvia
    lt: lithuania
    in: india, bharat
    pk: pakistan
    bd: bangladesh
    lk: sri lanka
    sg: singapore
    my: malaysia
    id: indonesia
    ph: philippines
    vn: vietnam, viet nam
    th: thailand
    jp: japan
    kr: south korea, korea
    cn: china
    hk: hong kong
    tw: taiwan
    au: australia
    nz: new zealand
    br: brazil, brasil
    mx: mexico
    ar: argentina
    cl: chile
    co: colombia
    pe: peru
    uy: uruguay
    za: south africa
    ng: nigeria
    ke: kenya
    gh: ghana
    eg: egypt
    ma: morocco
    il: israel
    tr: turkey, turkiye
    ae: uae, united arab emirates
    sa: saudi arabia
    eu: europe, european union, emea, eea
    apac: apac, asia, asia pacific
    latam: latam, latin america, south america""")
STATES = _aliases("""
    us: al, ak, az, ar, ca, co, ct, de, fl, ga, hi, ia, id, il, in, ks, ky, la, ma, md, me, mi, mn, mo, ms, mt, nc, nd, ne, nh, nj, nm, nv, ny, oh, ok, or, pa, ri, sc, sd, tn, tx, ut, va, vt, wa, wi, wv, wy, dc
    ca: on, bc, qc, ab, mb, sk, ns, nb, yt, nu, nt""")
CITIES = _aliases("""
    us: new york, nyc, brooklyn, san francisco, sf, bay area, silicon valley, los angeles, san diego, san jose, palo alto, mountain view, oakland, sunnyvale, cupertino, santa monica, seattle, austin, boston, chicago, denver, atlanta, miami, dallas, houston, phoenix, portland, philadelphia, washington dc, salt lake city, minneapolis, detroit, nashville, raleigh, charlotte, pittsburgh
    ca: toronto, vancouver, montreal, ottawa, calgary, waterloo
    uk: london, manchester, edinburgh, bristol, cambridge, oxford, birmingham, leeds, glasgow, belfast
    de: berlin, munich, munchen, hamburg, frankfurt, cologne, koln, stuttgart, dusseldorf, leipzig, karlsruhe
    nl: amsterdam, rotterdam, utrecht, eindhoven, the hague
    fr: paris, lyon, toulouse, marseille, bordeaux, lille, nantes
    es: madrid, barcelona, valencia, malaga, seville, sevilla
    pt: lisbon, lisboa, porto
    ie: dublin, cork, galway
    pl: warsaw, warszawa, krakow, cracow, wroclaw, gdansk, poznan
    ch: zurich, geneva, zug, basel, lausanne
    at: vienna, wien, graz
    se: stockholm, gothenburg, malmo
    no: oslo, bergen, trondheim
    dk: copenhagen, kobenhavn, aarhus
    fi: helsinki, tampere, espoo
    cz: prague, praha, brno
    it: milan, milano, rome, roma, turin, torino, bologna
    be: brussels, antwerp, ghent
    in: bangalore, bengaluru, mumbai, bombay, delhi, new delhi, gurgaon, gurugram, noida, hyderabad, pune, chennai, kolkata, ahmedabad, jaipur, kochi, indore, chandigarh, coimbatore
    ae: dubai, abu dhabi
    il: tel aviv, jerusalem, haifa
    au: sydney, melbourne, brisbane, perth, adelaide, canberra
    nz: auckland, wellington
    jp: tokyo, osaka, kyoto
    kr: seoul
    cn: beijing, shanghai, shenzhen, guangzhou, hangzhou
    tw: taipei
    br: sao paulo, rio de janeiro, belo horizonte, curitiba, porto alegre, florianopolis, recife
    mx: mexico city, guadalajara, monterrey
    ar: buenos aires, cordoba, rosario
    cl: santiago
    co: bogota, medellin, cali
    za: cape town, johannesburg, durban, pretoria
    ng: lagos, abuja
    ke: nairobi
    eg: cairo
    tr: istanbul, ankara, izmir
    gr: athens, thessaloniki
    hu: budapest
    ro: bucharest, cluj, cluj napoca, iasi, timisoara
    bg: sofia, plovdiv
    rs: belgrade, novi sad
    hr: zagreb, split
    ua: kyiv, kiev, lviv, kharkiv
    ru: moscow, saint petersburg
    ph: manila, cebu
    id: jakarta, bali
    my: kuala lumpur
    vn: hanoi, ho chi minh city, saigon, da nang
    th: bangkok
    pk: karachi, lahore, islamabad
    bd: dhaka
    lk: colombo
    sg: singapore""")
LOCATION_NOISE = _words("only based region area greater metro the and or preferred timezone timezones tz country countries hybrid office optional friendly")
MEANINGLESS_LOCATIONS = _names("multiple locations, multiple, various, various locations, other, unknown, unspecified, not specified, not applicable, n a, na, none, null, undefined, tbd")

# Descriptions.
BOILERPLATE = [
    r"equal opportunity employer[^.]*\.", r"without regard to race[^.]*\.", r"all qualified applicants[^.]*\.", r"we are an equal opportunity[^.]*\.",
    r"apply (now|here|today)", r"click here[^.]*\.", r"share this job", r"view (this )?job", r"unsubscribe[^.]*\.", r"cookie (policy|notice)",
    r"privacy policy", r"all rights reserved", r"powered by [a-z0-9_]+", r"seniority level|employment type|job function|job type",
]
ENTITIES = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "mdash": "-", "ndash": "-", "hellip": "..."}

# Skills as `name weight: other names`; those after the mark are not in the default profile.
SKILLS_TEXT = """
    react 3: react.js, reactjs
    next.js 3: nextjs, next js
    typescript 3: ts
    javascript 3: js
    node.js 3: node, nodejs
    flutter 3:
    dart 2:
    tailwind 2: tailwind css, tailwindcss
    redux toolkit 2: redux
    tanstack query 2: react query
    mongodb 2:
    rest api 2: restful, rest apis
    aws amplify 2: amplify
    appwrite 1:
    azure devops 2: azure ci/cd, azure, ci/cd
    github actions 2: ci/cd pipeline
    monorepo 2: turborepo, nx monorepo
    microservices 2: microservice
    api integration 2: third-party api, third party api
    agile 1: scrum
    git 2:
    architecture 2: system design, architecture design
    agentic ai 4: ai agent, ai agents, autonomous agent
    llm 4: large language model, llm orchestration
    rag 4: retrieval augmented generation, rag pipeline
    multi-agent 4: multi agent, multiagent
    mcp 4: model context protocol
    prompt engineering 3:
    openrouter 2:
    claude 2: claude ai, anthropic
    copilot 1: github copilot
    perplexity 1:
    openclaw 1:
    express.js 2: express
    sql 2: mysql
    python 2:
    docker 2:
    aws s3 1:
    aws lambda 1: serverless
    iis 1:
    vitest 2: unit testing, integration testing
    vector search 3: faiss, pgvector, vector database
    postgresql 2: postgres
    sqlite 1:
    react native 1:
    machine learning 1: ml
    --
    vue 3: vue.js, vuejs, nuxt
    angular 3: angularjs
    svelte 2: sveltekit
    java 3: spring, spring boot
    kotlin 2:
    swift 2: swiftui, ios
    go 3: golang
    rust 3:
    ruby 2: rails, ruby on rails
    php 2: laravel
    c# 2: .net, dotnet, asp.net
    django 2:
    fastapi 2:
    graphql 2: apollo
    kubernetes 2: k8s
    terraform 2:
    redis 1:
    kafka 2:
    elasticsearch 2:
    figma 1:"""


def _skills(text: str) -> list[tuple[str, float, list[str]]]:
    lines = (line.strip().split(":", 1) for line in text.strip().splitlines())
    return [(head.rpartition(" ")[0], float(head.rpartition(" ")[2]), _names(names)) for head, names in lines]


DEFAULT_SKILLS = _skills(SKILLS_TEXT.partition("--")[0])
SKILLS = DEFAULT_SKILLS + _skills(SKILLS_TEXT.partition("--")[2])

# Roles.
TARGET_ROLES = _names("""full stack developer, full stack engineer, software engineer, frontend engineer, front end developer, react developer,
    next.js developer, node.js developer, flutter developer, ai engineer, agentic ai engineer, llm engineer, applied ai engineer, founding engineer""")
ROLE_VOCABULARY = _names("""full stack developer, full stack engineer, software engineer, software developer, frontend engineer, front end developer,
    backend engineer, back end developer, react developer, next.js developer, node.js developer, flutter developer, mobile developer, android developer,
    ios developer, ai engineer, agentic ai engineer, llm engineer, applied ai engineer, machine learning engineer, data engineer, devops engineer,
    platform engineer, founding engineer""")
VETO_PHRASES = _names("sales, marketing, recruiter, recruiting, account executive, business development, customer success, solutions consultant")
CONTRACT_KEYWORDS = _names("react, next.js, nextjs, typescript, node, flutter, ai agent, llm, rag, chatbot, automation, mvp, full stack")

# Eligibility by place, as alternations.
WORLDWIDE = r"worldwide|anywhere|everywhere|global(?:ly)?|international|any\s+country|no\s+location\s+restriction"
INDIA = r"india|bengaluru|bangalore|mumbai|new\s+delhi|gurgaon|gurugram|noida|pune|chennai|kolkata|ahmedabad|mohali|chandigarh|jaipur|dehradun|indore|coimbatore|nagpur|lucknow|bhopal|vadodara|thiruvananthapuram|mysuru|mysore|jamshedpur|ranchi|kharagpur|tikamgarh|krishnagiri|wayanad|ajmer|rajkot|faridabad"
PERHAPS_INDIA = r"delhi|hyderabad|kochi|surat"
OTHER_COUNTRY = r"pakistan|japan|thailand|indonesia|philippines|usa?|u\.s\.a?\.?|united\s+states|america|americas|canada|uk|united\s+kingdom|england|scotland|wales|europe|european|eu|emea|eea|latam|latin\s+america|south\s+america|australia|new\s+zealand|anz"
APAC = r"apac|asia[\s-]?pacific|asia"
RESTRICTED = [
    ("us", r"usa?|united\s+states|americas?"), ("ca", "canada|canadian"), ("uk", r"uk|u\.k\.|united\s+kingdom|great\s+britain|england|scotland|wales"),
    ("eu", "eu|europe|european|emea|eea"), ("latam", r"latam|latin\s+america|south\s+america"), ("anz", r"australia|new\s+zealand|anz"),
]

# States of postings and leads.
WORKING_STATUSES = _words("matched ready_for_review applied sent responded interview offer")
ARCHIVED_STATUSES = _words("ignored rejected closed")
NEXT_JOB_STAGE = {"enrich": "score", "score": "draft", "draft": "dispatch", "dispatch": "done", "done": "done"}
NEXT_LEAD_STAGE = {"score": "draft", "draft": "dispatch", "dispatch": "done", "done": "done"}
TERMINAL_JOB_STATUSES = _words("rejected ignored closed")
TERMINAL_LEAD_STATUSES = _words("rejected ignored won lost")
MAX_ATTEMPTS = 5

# Senders that nobody reads.
BOUNCE_SENDERS = _words("mailer-daemon postmaster bounce bounces")
UNATTENDED_SENDERS = _words("no-reply noreply do-not-reply donotreply")
AUTO_PRECEDENCE = _words("auto_reply auto-reply auto_replied")
