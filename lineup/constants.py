"""Fixed values that must equal the reference's for equal results.

Kept together and in the reference's natural order.
"""

# Team full name -> abbreviation (30 teams, listed by conference
# and division as in the reference).
TEAM_ABBREVIATIONS = [
    ("Boston Celtics", "BOS"),
    ("Brooklyn Nets", "BKN"),
    ("New York Knicks", "NYK"),
    ("Philadelphia 76ers", "PHI"),
    ("Toronto Raptors", "TOR"),
    ("Chicago Bulls", "CHI"),
    ("Cleveland Cavaliers", "CLE"),
    ("Detroit Pistons", "DET"),
    ("Indiana Pacers", "IND"),
    ("Milwaukee Bucks", "MIL"),
    ("Atlanta Hawks", "ATL"),
    ("Charlotte Hornets", "CHA"),
    ("Miami Heat", "MIA"),
    ("Orlando Magic", "ORL"),
    ("Washington Wizards", "WAS"),
    ("Denver Nuggets", "DEN"),
    ("Minnesota Timberwolves", "MIN"),
    ("Oklahoma City Thunder", "OKC"),
    ("Portland Trail Blazers", "POR"),
    ("Utah Jazz", "UTA"),
    ("Golden State Warriors", "GSW"),
    ("Los Angeles Clippers", "LAC"),
    ("Los Angeles Lakers", "LAL"),
    ("Phoenix Suns", "PHX"),
    ("Sacramento Kings", "SAC"),
    ("Dallas Mavericks", "DAL"),
    ("Houston Rockets", "HOU"),
    ("Memphis Grizzlies", "MEM"),
    ("New Orleans Pelicans", "NOP"),
    ("San Antonio Spurs", "SAS"),
]

# Team profiles (points, points allowed, win rate) and the
# league-average default used for any other team.
TEAM_PROFILES = [
    ("GSW", 115.2, 110.1, 0.634),
    ("BOS", 117.9, 111.6, 0.622),
    ("LAL", 112.8, 113.2, 0.528),
    ("MIA", 110.9, 107.8, 0.583),
]
LEAGUE_AVERAGE_PROFILE = (112.0, 112.0, 0.500)
HOME_POINTS_BOOST = 2.5
HOME_WIN_SHIFT = 0.05
WIN_RATE_CLAMP = (0.05, 0.95)

# Confidence buckets (right-closed) and their labels.
CONFIDENCE_EDGES = [0.0, 0.6, 0.7, 0.8, 1.0]
CONFIDENCE_LABELS = ["<60%", "60-70%", "70-80%", ">80%"]

# Season calendar.
SEASON_LAST_MONTH = 6          # Jan-Jun belong to the season that started the year before
SEASON_FIRST_MONTH = 10        # in-season: month >= 10 or month <= 6
REFRESH_WEEKDAYS = (1, 2)      # Tuesday, Wednesday (Monday = 0)
GAMES_PER_SEASON = 82
SEASON_LENGTH_DAYS = 170
MID_SEASON_GAME = 41
SCHEDULE_UTC_OFFSET_HOURS = -5

# Words in the names of date columns.
DATE_KEYWORDS = ("date", "year", "season", "game_date")

# Thresholds of the team tables (form, colour classes, outliers).
FORM_MARGIN = 0.1
RATE_CLASSES = (0.4, 0.6)
DIFF_CLASSES = (-5, 0, 5)
OUTLIER_DIFF = 8
OUTLIER_RATES = (0.3, 0.7)
