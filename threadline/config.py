"""Dimension data and thresholds; every operator takes an override."""

from __future__ import annotations

# All lists, tables and patterns of this module are fixed values: they must equal those of the workload that this library serves.
BOT_ACCOUNTS = [
    "AutoModerator", "autotldr", "empleadoEstatalBot", "RemindMeBot", "TweetPoster", "imguralbumbot", "sneakpeekbot", "RepostSleuthBot",
    "WikiTextBot", "HelperBot_", "GoodBot_BadBot", "timezone_bot", "WikiSummarizerBot", "stabbot", "totesmessenger", "TotesMessenger",
    "sub_doesnt_exist_bot", "SnapshillBot", "B0tRank", "Flair_Helper", "MAGIC_EYE_BOT", "SaveVideo", "savevideo", "downloadvideo", "VredditDownloader",
]
DELETED_MARKERS = ["[deleted]", "[removed]", "[deleted by user]"]
DELETED_AUTHORS = ["[deleted]", "deleted", ""]
MEDIA_DOMAINS = [
    "imgur.com", "i.imgur.com", "i.redd.it", "v.redd.it", "giphy.com", "gfycat.com", "streamable.com",
    "youtube.com", "youtu.be", "twitter.com", "x.com", "preview.redd.it", "external-preview.redd.it",
]
MODERATION_PATTERNS = [
    r"this (post|comment|submission) has been removed", r"your (post|comment|submission) has been removed", r"removed.*rule", r"rule \d+",
    r"violat(es?|ing|ion)", r"banned from", r"moderator(s)?", r"automod(erator)?", r"please read (the|our) rules", r"flair your post",
    r"this is a reminder", r"i am a bot", r"beep boop", r"\*i am a bot\*", r"bot action", r"this action was performed automatically",
]
LOW_VALUE_PATTERNS = [
    r"^(lol|lmao|haha|jaja|xd|ok|yes|no|this|same|true|nice|thanks|agreed)\.?$", r"^\^this\.?$", r"^r/\w+$", r"^u/\w+$", r"^\[deleted\]$", r"^\[removed\]$",
]
#: (key, name, start, end, priority), in their order: of overlapping periods the last holds.
PERIODS = [
    ("maduro_inauguration_2013", "Maduro Inauguration 2013", "2013-04-14T00:00:00", "2013-04-30T23:59:59", "high"),
    ("protests_2014", "2014 Venezuelan Protests", "2014-02-01T00:00:00", "2014-05-31T23:59:59", "critical"),
    ("oil_price_crash_2014", "Oil Price Crash Impact", "2014-11-01T00:00:00", "2015-02-28T23:59:59", "high"),
    ("trump_sanctions_2017", "Trump Administration Sanctions", "2017-08-01T00:00:00", "2017-09-30T23:59:59", "critical"),
    ("maduro_reelection_2018", "2018 Disputed Election", "2018-05-15T00:00:00", "2018-05-31T23:59:59", "high"),
    ("guaido_recognition_2019", "Guaido Recognition Crisis", "2019-01-20T00:00:00", "2019-02-28T23:59:59", "critical"),
    ("failed_uprising_2019", "April 2019 Uprising Attempt", "2019-04-28T00:00:00", "2019-05-05T23:59:59", "high"),
    ("biden_policy_2021", "Biden Administration Policy Shift", "2021-01-20T00:00:00", "2021-03-31T23:59:59", "medium"),
    ("election_2024", "2024 Venezuelan Election Crisis", "2024-07-20T00:00:00", "2024-08-15T23:59:59", "critical"),
    ("gonzalez_exile_2024", "Gonzalez Urrutia Exile", "2024-09-01T00:00:00", "2024-09-15T23:59:59", "high"),
]
#: (window, start, end) and (window, day, event) of the timelines.
TIMELINE_WINDOWS = [
    ("Guaido Crisis 2019", "2019-01-01", "2019-05-31"), ("2024 Election Crisis", "2024-07-01", "2024-09-30"), ("Trump Sanctions 2017", "2017-07-01", "2017-10-31"),
]
TIMELINE_EVENTS = [
    ("Guaido Crisis 2019", "2019-01-23", "Guaido Declares Presidency"), ("Guaido Crisis 2019", "2019-02-23", "Aid Standoff"), ("Guaido Crisis 2019", "2019-04-30", "Failed Uprising"),
    ("2024 Election Crisis", "2024-07-28", "Election Day"), ("2024 Election Crisis", "2024-08-02", "Protests Erupt"), ("2024 Election Crisis", "2024-09-08", "Gonzalez Exile"),
    ("Trump Sanctions 2017", "2017-08-11", "Trump Threat"), ("Trump Sanctions 2017", "2017-08-25", "Financial Sanctions"),
]
TOPIC_TERMS = {
    "Political": ["maduro", "guaido", "chavez", "opposition", "government", "regime", "dictator", "democracy"],
    "Economic": ["oil", "sanctions", "economy", "inflation", "crisis", "pdvsa", "currency", "petro"],
    "Humanitarian": ["humanitarian", "refugees", "migration", "food", "medicine", "shortage", "aid"],
    "Military": ["military", "army", "intervention", "coup", "colectivos", "national guard"],
    "Diplomatic": ["diplomatic", "recognition", "embassy", "relations", "lima group", "negotiations"],
}
KEYWORD_GROUPS = {
    "India-Pakistan": ["india", "pakistan"], "Kashmir": ["kashmir", "j&k", "jammu"], "Pulwama": ["pulwama", "crpf"], "Balakot": ["balakot", "airstrike", "surgical"],
    "Article 370": ["article 370", "370", "special status"], "Nuclear": ["nuclear", "atomic", "nuke"], "Military": ["army", "military", "defense"],
    "Terror": ["terror", "terrorist", "attack"], "Ceasefire": ["ceasefire", "peace"], "Op Sindoor": ["sindoor", "pahalgam"],
}
SEARCH_QUERIES = {
    "bilateral": ["Venezuela US", "Venezuela United States", "US Venezuela relations", "American Venezuela", "Venezuela Washington"],
    "political": ["Maduro", "Guaido", "Venezuela election", "Venezuela democracy", "Venezuela opposition", "Venezuela government", "Chavismo"],
    "economic": ["Venezuela sanctions", "Venezuela oil", "PDVSA", "Venezuela economy", "Venezuela inflation", "Venezuela currency", "petro cryptocurrency"],
    "humanitarian": ["Venezuela crisis", "Venezuela humanitarian", "Venezuela refugees", "Venezuela migration", "Venezuela food shortage", "Venezuela medicine"],
    "military": ["Venezuela military", "Venezuela intervention", "Venezuela coup", "Venezuela army", "colectivos"],
    "diplomatic": ["Venezuela diplomacy", "Venezuela embassy", "Venezuela recognition", "Lima Group", "Venezuela UN"],
}
PRIORITY_QUERIES = ["Venezuela", "Maduro", "Venezuela US", "Venezuela sanctions", "Guaido", "Venezuelan crisis", "Venezuela oil", "Caracas", "Venezuela election", "Venezuela humanitarian"]
CRISIS_QUERIES = ["Venezuela", "Maduro", "Guaido", "Venezuela election", "Venezuela sanctions", "Venezuela crisis", "Venezuela coup", "Venezuela intervention", "Venezuela oil", "Venezuelan"]
COMMUNITY_PERSPECTIVES = {
    "us_perspective": ["politics", "news", "worldnews", "Conservative", "neoliberal"], "venezuela_perspective": ["venezuela", "vzla"],
    "regional": ["LatinAmerica", "southamerica"], "ideological": ["socialism", "Libertarian", "geopolitics"],
}
COMMUNITY_GROUPS = {
    "venezuela": ["venezuela", "vzla"], "us_mainstream": ["politics", "news", "worldnews"], "us_conservative": ["Conservative", "Libertarian"],
    "us_progressive": ["neoliberal", "socialism"], "regional": ["LatinAmerica", "geopolitics"],
}
COMMUNITIES = ["venezuela", "vzla", "politics", "news", "worldnews", "geopolitics", "LatinAmerica", "Conservative", "neoliberal", "socialism", "Libertarian"]
CRISIS_COMMUNITIES = ["venezuela", "vzla", "worldnews", "politics", "news", "geopolitics", "LatinAmerica"]
REGION_COMMUNITIES = ["vzla", "venezuela"]
COMMENT_FIELDS = ["id", "body", "author", "subreddit", "created_utc", "score", "link_id", "parent_id", "controversiality", "is_submitter", "distinguished", "edited", "permalink"]
#: The usual English list (public domain).
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she she's her hers herself it it's its itself
they them their theirs themselves what which who whom this that that'll these those am is are was were be been being have has had having do does did doing a an the
and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under
again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don
don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
EXTRA_STOPWORDS = """
said says would could also one two new first last many much even still well back now get got way take make made come going go see like know think want say look
time year years day days week today news report reddit post comments amp people thing something really actually just right need let us im dont thats cant wont didnt
doesnt isnt arent wasnt werent youre hes shes theyre weve youve theyve id youd hed wed theyd ill youll hell shell theyll
""".split()
