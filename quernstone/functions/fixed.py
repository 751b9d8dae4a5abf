"""Word lists, tables and patterns that results depend on."""

# Fixed values. The word that stands for a missing text.
UNKNOWN = "Onbekend"

# Fixed values. Months by their names.
MONTHS = {
    "jan": 1, "januari": 1, "january": 1,
    "feb": 2, "februari": 2, "february": 2,
    "mrt": 3, "maart": 3, "mar": 3, "march": 3,
    "apr": 4, "april": 4,
    "mei": 5, "may": 5,
    "jun": 6, "juni": 6, "june": 6,
    "jul": 7, "juli": 7, "july": 7,
    "aug": 8, "augustus": 8, "august": 8,
    "sep": 9, "sept": 9, "september": 9,
    "okt": 10, "oktober": 10, "oct": 10, "october": 10,
    "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}

# Fixed values. Phrases that say whether something is free, paid by gift, or needs a reservation.
FREE = ("gratis", "gratis toegang", "vrij entree", "vrije entree", "entree vrij", "toegang vrij", "vrij toegankelijk", "geen entree", "kosteloos", "free entrance", "gratis te bezoeken", "toegang gratis", "gratis deelname")
DONATION = ("vrije gift", "donatie", "fooienpot", "hoed rond")
RESERVATION_YES = (
    "reserveren verplicht", "reservering verplicht", "aanmelden verplicht", "vooraf reserveren", "vooraf aanmelden", "reserveer je plek", "reserveren noodzakelijk", "tickets verplicht",
    "alleen op reservering", "inschrijven verplicht", "aanmelding vereist", "kaartverkoop", "koop je ticket", "reserveren gewenst", "graag reserveren", "reserveer nu", "tickets bestellen", "meld je aan",
)
RESERVATION_NO = ("reserveren niet nodig", "geen reservering nodig", "zonder aanmelding", "vrije inloop", "inloop", "aanmelden niet nodig", "reserveren is niet nodig", "gewoon langskomen", "geen aanmelding")

# Fixed values. Hosts that are never candidate pages.
BLOCKED_HOSTS = (
    "facebook.com", "instagram.com", "tiktok.com", "pinterest.", "youtube.com", "youtu.be", "twitter.com", "x.com",
    "linkedin.com", "booking.com", "tripadvisor.", "airbnb.", "expedia.", "zoover.", "google.", "gstatic",
    "wikipedia.org", "wikimedia", "marktplaats.nl", "funda.nl", "werkenbij", "amazon.", "bol.com",
    "brave.com", "duckduckgo.com", "startpage.com", "mojeek.com", "marginalia.nu", "bing.com", "ecosia.org",
    "spotify.com", "apple.com", "adobe.com", "wordpress.org", "w3.org", "schema.org",
    "hema.nl", "calendar.google", "iagenda.com", "uitagendarotterdam",
)
ASSETS = ("jpg", "jpeg", "png", "gif", "svg", "pdf", "zip", "mp4", "webp", "css", "js", "ico")

# Fixed values. Tiers of sources from most to least trusted, and the order of confidence.
TIERS = ("PrimaryOrganizer", "OfficialVenue", "OfficialLocal", "TouristCalendar", "Aggregator", "Social")
CONFIDENCE = ("Onbekend", "Onzeker", "Bevestigd")
