"""Word tables of the cleaning rules.

Fixed values: they must equal the published tables for the same results, and their order decides the result, since the
rules run in this order. Nothing here is derived, packed or sorted."""

# Words for "and" between two spaces that become &.
AND_WORDS = [
    "AND",
    "EN",
    "DHE",
    "və",
    "ETA",
    "и",
    "OG",
    "KAJ",
    "JA",
    "AT",
    "ET",
    "UND",
    "AK",
    "ES",
    "DAN",
    "AGUS",
    "UN",
    "IR",
    "SI",
    "IN",
    "Y",
    "NA",
    "OCH",
    "VE",
    "VA",
    "SAMT",
]

# Legal forms, in the order in which they are tried.
LEGAL_FORMS = [
    "BT",
    "GMBH",
    "PMDN",
    "OYJ",
    "EPE",
    "RT",
    "SGPS",
    "PRC",
    "OHG",
    "RAS",
    "SAS",
    "SPA",
    "KB",
    "GIE",
    "TD",
    "PRP LTD",
    "SNC",
    "DBA",
    "APS",
    "OE",
    "A EN P",
    "EXT",
    "KAS",
    "SCS",
    "OY",
    "SENC",
    "APB",
    "OU",
    "S DE RL",
    "GBR",
    "KOM SRK",
    "HB",
    "EEG",
    "HF",
    "LDC",
    "SK",
    "LDA",
    "PT",
    "LLP",
    "SCA",
    "EE",
    "PTY",
    "LLC",
    "LTDA",
    "SCP",
    "PL",
    "SOPARFI",
    "EIRL",
    "GCV",
    "JTD",
    "EV",
    "CA",
    "SA",
    "VOF",
    "SAICA",
    "KKT",
    "AVV",
    "SAPA",
    "SPRL",
    "SPOL SRO",
    "NA",
    "INC",
    "GESMBH",
    "DOO",
    "ACE",
    "KOL SRK",
    "S EN C",
    "KGAA",
    "KDD",
    "GMBH  CO KG",
    "KDA",
    "APS  CO KS",
    "ASA",
    "PMA",
    "NT",
    "DD",
    "NV",
    "TLS",
    "SP ZOO",
    "DNO",
    "SRL",
    "CORP",
    "LTD",
    "ELP",
    "EURL",
    "CV",
    "PC LTD",
    "KG",
    "SARL",
    "KD",
    "KK",
    "SP",
    "BV",
    "KS",
    "CVOA",
    "PLC",
    "KV",
    "SC",
    "KY",
    "LTEE",
    "BPK",
    "IBC",
    "DA",
    "BVBA",
    "CVA",
    "KFT",
    "SAFI",
    "EOOD",
    "SA DE CV",
    "S EN NC",
    "AMBA",
    "SDN BHD",
    "AC",
    "AB",
    "AE",
    "AD",
    "AG",
    "IS",
    "ANS",
    "AL",
    "AS",
    "OOD",
    "VOS",
    "VEB",
    "CO",
]

# Forms that the old pattern could only match after a line break.
LATE_FORMS = [
    "SPA",
    "KAS",
    "HF",
    "PL",
    "AVV",
    "S EN C",
    "DD",
    "PC LTD",
    "KY",
    "S EN NC",
    "OOD",
]

# British spelling: American spelling. FIBERGLASS counts only before an E.
UK_US = {
    "ANALYSE": "ANALYZE",
    "ARMOUR": "ARMOR",
    "COLOUR": "COLOR",
    "FLUIDISE": "FLUIDIZE",
    "IMMOBILISE": "IMMOBILIZE",
    "IONISE": "IONIZE",
    "MOULD": "MOLD",
    "POLARISE": "POLARIZE",
    "POLYMERISE": "POLYMERIZE",
    "UNAUTHORISE": "UNAUTHORIZE",
    "CENTRE": "CENTER",
    "LANDMINE": "LAND MINE",
    "MITRE": "MITER",
    "POLYMERISABLE": "POLYMERIZABLE",
    "PROGRAMME": "PROGRAM",
    "THEATRE": "THEATER",
    "TYRE": "TIRE",
    "ANAESTHETISING": "ANESTHETIZING",
    "ANALYSING": "ANALYZING",
    "ANODISING": "ANODIZING",
    "ARMOURING": "ARMORING",
    "ATOMISING": "ATOMIZING",
    "CAUTERISING": "CAUTERIZING",
    "CENTRING": "CENTERING",
    "COLOURING": "COLORING",
    "CROSSLINKING": "CROSS-LINKING",
    "CRYSTALLISING": "CRYSTALLIZING",
    "DECOLOURISING": "DECOLORIZING",
    "DEMAGNETISING": "DEMAGNETIZING",
    "DEODORISING": "DEODORIZING",
    "DEPOLARISING": "DEPOLARIZING",
    "DEPOLYMERISING": "DEPOLYMERIZING",
    "DESULFURISING": "DESULFURIZING",
    "EQUALISING": "EQUALIZING",
    "FERTILISING": "FERTILIZING",
    "FLAVOURING": "FLAVORING",
    "FLUIDISING": "FLUIDIZING",
    "GALVANISING": "GALVANIZING",
    "GRAPHITISING": "GRAPHITIZING",
    "HOMOGENISING": "HOMOGENIZING",
    "IMMUNISING": "IMMUNIZING",
    "ISOMERISING": "ISOMERIZING",
    "LOCALISING": "LOCALIZING",
    "MAGNETISING": "MAGNETIZING",
    "MALLEABILISING": "MALLEABLEIZING",
    "MANOEUVRING": "MANEUVERING",
    "MERCERISING": "MERCERIZING",
    "METALLISING": "METALIZING",
    "MINIMISING": "MINIMIZING",
    "MOULDING": "MOLDING",
    "NEUTRALISING": "NEUTRALIZING",
    "OXIDISING": "OXIDIZING",
    "OZONISING": "OZONIZING",
    "PASTEURISING": "PASTEURIZING",
    "PLOUGHING": "PLOWING",
    "PRACTISING": "PRACTICING",
    "PULVERISING": "PULVERIZING",
    "RECOGNISING": "RECOGNIZING",
    "SENSITISING": "SENSITIZING",
    "SUBSIDISING": "SUBSIDIZING",
    "SYNTHESISING": "SYNTHESIZING",
    "TABLETTING": "TABLETING",
    "VULCANISING": "VULCANIZING",
    "TORCH": "FLASHLIGHT",
    "PETROL": "GASOLINE",
    "ALUMINIUM": "ALUMINUM",
    "CARBONISATION": "CARBONIZATION",
    "CAUTERISATION": "CAUTERIZATION",
    "CYCLISATION": "CYCLIZATION",
    "FERTILISATION": "FERTILIZATION",
    "IONISATION": "IONIZATION",
    "MAGNETISATION": "MAGNETIZATION",
    "MINERALISATION": "MINERALIZATION",
    "NEUTRALISATION": "NEUTRALIZATION",
    "OPTIMISATION": "OPTIMIZATION",
    "POLARISATION": "POLARIZATION",
    "STERILISATION": "STERILIZATION",
    "SYNCHRONISATION": "SYNCHRONIZATION",
    "FERTILISER": "FERTILIZER",
    "HARBOUR": "HARBOR",
    "MULTICOLOUR": "MULTICOLOR",
    "ODOUR": "ODOR",
    "PARLOUR": "PARLOR",
    "SULPHUR": "SULFUR",
    "VAPOUR": "VAPOR",
    "AEROPLANE": "AIRPLANE",
    "ANAESTHETIC": "ANESTHETIC",
    "ANALYSER": "ANALYZER",
    "ATOMISER": "ATOMIZER",
    "CALIBRE": "CALIBER",
    "CALLIPER": "CALIPER",
    "CARBURETTOR": "CARBURETOR",
    "DESENSITISER": "DESENSITIZER",
    "DOWNPIPE": "DOWNSPOUT",
    "DYKE": "DIKE",
    "ECONOMISER": "ECONOMIZER",
    "ENCYCLOPAEDIA": "ENCYCLOPEDIA",
    "FIBREGLASS": "FIBERGLASS",
    "FIBRE": "FIBER",
    "HAEMORRHOID": "HEMORRHOID",
    "MACHETE": "MATCHETE",
    "METACENTRE": "METACENTER",
    "MOLLUSC": "MOLLUSK",
    "NEBULISER": "NEBULIZER",
    "PLASTICISER": "PLASTICIZER",
    "PYJAMA": "PAJAMA",
    "SECATEUR": "PRUNING SHEAR",
    "SELVEDGE": "SELVAGE",
    "STABILISER": "STABILIZER",
    "SULPHATE": "SULFATE",
    "SULPHITE": "SULFITE",
    "TRAM": "STREETCAR",
    "VAPORISER": "VAPORIZER",
    "WINDSCREEN": "WINDSHIELD",
    "BISCUIT": "COOKIE",
    "LIFT": "ELEVATOR",
    "GYNAECOLOGY": "GYNECOLOGY",
    "JEWELLERY": "JEWELRY",
    "NAPPY": "DIAPER",
}

# Short form: what it stands for.
ABBREVIATIONS = {
    "MIJ": ["MAATSCHAPPIJ"],
    "MIN": ["MINISTERIUM", "MINISTERSTVA", "MINISTERSTWO", "MINISTERSTVAM", "MINISTERSTVO", "MINISTERSTV", "MINISTERO", "MINISTERSTVU", "MINISTERE", "MINISTERUL", "MINISTRY", "MINISTERSTVE", "MINISTER", "MINISTERSTVOM", "MINISTRE", "MINISTERSTVAKH", "MINISTERSTVAMI"],
    "PREL": ["PRELUCRARE"],
    "BV": ["BESLOTEN VENNOOTSCHAP", "BEPERKTE AANSPRAKELIJKHEID", "BESLOTEN VENNOOTSCHAP MET"],
    "KOMB": ["KOMBINATU", "KOMBINATY", "KOMBINAT"],
    "NAT": ["NATIONAAL", "NATIONALE", "NATIONAL", "NATIONAUX"],
    "NAZ": ["NAZIONALE", "NAZIONALI"],
    "CONSOL": ["CONSOLIDATED"],
    "CHEM": ["CHEMICKEJ", "CHEMICZNY", "CHEMICKY", "CHEMII", "CHEMICALS", "CHEMICAL", "CHEMISTRY", "CHEMICKE", "CHEMISCHE", "CHEMISCH", "CHEMICKYCH", "CHEMICZNE", "CHEMISKEJ", "CHEMIE"],
    "GHH": ["GUTEHOFFNUNGSCHUTTE", "GUTEHOFFNUNGSCHUETTE"],
    "ALLG": ["ALLGEMEINE", "ALLGEMEINER"],
    "STIINT": ["STIINTIFICA"],
    "CO": ["COMPANY", "COMPANIES"],
    "GK": ["GOMEI KAISHA", "GOMEI GAISHA", "GKGOUSHI GAISHA", "GOSHI KAISHA"],
    "VVU": ["VYZK VYVOJOVY USTAV", "VYZKUMNY VYVOJOVY USTAV"],
    "OHG": ["OFFENE HANDELSGESELLSCHAFT"],
    "INST NAT": ["INSTITUTE NATIONALE", "INSTITUT"],
    "CENT": ["CENTRAUX", "CENTRAL", "CENTRALA", "CENTER", "CENTRE", "CENTRALES", "CENTRAAL", "CENTRUM", "CENTRO", "CENTRALE", "CENTRUL"],
    "DEPT": ["DEPARTEMENT", "DEPARTMENT"],
    "RES": ["RESEARCH"],
    "SAS": ["SOCIETA IN ACCOMANDITA SEMPLICE"],
    "SPA": ["SOCIETA PER AZIONI"],
    "VVB": ["VEREINIGUNG VOLKSEIGENER BETRIEBUNG"],
    "BRDR": ["BRODRENE", "BROEDRENE", "BRODERNA", "BROEDERNA"],
    "RIJKSUNIV": ["RIJKSUNIVERSITEIT"],
    "SH": ["SHADAN HOUJIN", "SHADAN HO"],
    "OFF NAT": ["OFFICINE NATIONALE"],
    "KB": ["KOMMANDIT BOLAG", "KOMMANDITBOLAGET", "KOMMANDIT BOLAGET", "KOMMANDITBOLAG"],
    "ETUD": ["ETUDES", "ETUDE"],
    "FRAT": ["F LLI", "FRATELLI", "FLLI"],
    "VERW GES": ["VERWALTUNGSGESELLSCHAFT"],
    "SOC APPL": ["SOCIETA APPLICAZIONE", "SOCIETE APPLICATION"],
    "ZENT": ["ZENTRALE", "ZENTRALNA", "ZENTRALEN", "ZENTRALES", "ZENTRUM"],
    "GH": ["GAKKO HOJIN", "GAKKO HOUJIN"],
    "BET-GMBH": ["BETEILIGUNGS GESELLSCHAFT MIT", "BETEILIGUNGSGESELLSCHAFT MBH", "GESELLSCHAFT MIT BESCHRAENKTER"],
    "SOC CHIM": ["SOCIETE CHIMIQUE"],
    "SNC": ["SOCIETA IN NOME COLLECTIVO", "SOCIETE EN NOM COLLECTIF"],
    "VEB": ["VOLKSEIGENER BETRIEBE"],
    "APS": ["ANPARTSSELSKABET", "ANPARTSSELSKAB"],
    "APP": ["APPARATUS", "APPARECHHI", "APPAREIL", "APPAREILS", "APPARATE", "APPARATEBAU", "APPAREILLAGES", "APPAREILLAGE"],
    "PRELUC": ["PRELUCRAREA"],
    "GMBH": ["BESCHRANKTER HAFTUNG", "GESELLSCHAFT MBH", "GESELLSCHAFT MIT"],
    "LAB": ["LABORATOIR", "LABORATORIOS", "LABORATORIJ", "LABORATORIES", "LABORATOIRES", "LABORTORI", "LABORATORIO", "LABORATORI", "LABORATORIEI", "LABORATORY", "LABORATOIRE", "LABORATORIUM", "LABORATORII"],
    "ONTWIK": ["ONTWIKKELINGS", "ONTWIKKELINGSBUREAU"],
    "WISS": ["WISSENSCHAFTLICHES", "WISSENSCHAFTLICHE"],
    "CIE FR": ["COMPAGNIE FRANCAISE"],
    "SCHWEIZ": ["SCHWEIZER", "SCHWEIZERISCHER", "SCHWEIZERISCHES", "SCHWEIZERISCH", "SCHWEIZERISCHE"],
    "SUDDEUT": ["SUDDEUTSCH", "SUDDEUTSCHE", "SUDDEUTSCHER", "SUDDEUTSCHES"],
    "KI": ["KUTATO INTEZET", "KUTATO INTEZETE", "KUTATOINTEZET", "KUTATOINTEZETE"],
    "OP": ["OBOROVY PODNIK"],
    "OFF MEC": ["OFFICINE MECCANICHE", "OFFICINE MECCANICA"],
    "ZENT INST": ["ZENTRALINSTITUT"],
    "DEV": ["DEVELOPMENTS", "DEVELOPPEMENTS", "DEVELOP", "DEVELOPPEMENT", "DEVELOPMENT"],
    "SOC ALSAC": ["SOCIETE ALSACIENNE"],
    "CONSTR": ["CONSTRUCTIONS", "CONSTRUCTION", "CONSTRUCTII", "CONSTRUCTOR", "CONSTRUCTIILOR", "CONSTRUCCIONE", "CONSTRUCCION", "CONSTRUCTORTUL", "CONSTRUCTIE", "CONSTRUCCIONES", "CONSTRUCTORUL"],
    "HB": ["HANDELS BOLAGET", "HANDELSBOLAGET"],
    "SOC TECH": ["SOCIETE TECHNIQUE", "SOCIETE TECHNIQUES"],
    "GES": ["GESELLSCHAFT"],
    "SCI": ["SCIENTIFIQUES", "SCIENCES", "SCIENTIFICA", "SCIENCE", "SCIENTIFIC", "SCIENTIFIQUE"],
    "US DEPT": ["UNITED STATES OF AMERICA AS REPRESENTED BY THE UNITED STATES DEPARTMENT"],
    "MFG": ["MANUFACTURING", "MANUFACTURINGS"],
    "SOC EXPL": ["SOCIETE EXPLOITATION"],
    "US SEC": ["UNITED STATES OF AMERICA REPRESENTED BY THE SECRETARY", "UNITED STATES GOVERNMENT AS REPRESENTED BY THE SECRETARY OF", "UNITED STATES OF AMERICA SECRETARY OF"],
    "INST FR": ["INSTITUTE FRANCAISE"],
    "MFR": ["MANUFACTURER", "MANIFATTURA", "MANUFACTURAS", "MANIFATTURE", "MANUFACTURE", "MANUFATURA", "MANIFATTURAS", "MANUFACTURES", "MANUFACTURERS"],
    "OSTE": ["OSTERREICHISCHE", "OSTERREICHISCHES", "OSTERREICHISCH"],
    "PTY": ["PROPRIETARY"],
    "RES & DEV": ["RESEARCH & DEVELOPMENT", "RESEARCH AND DEVELOPMENT"],
    "LTDA": ["LIMITADA"],
    "ZAVOD": ["ZAVODU", "ZAVODY"],
    "GEN": ["GENERALES", "GENERAUX", "GENERAL", "GENERALE", "GENERALA"],
    "KUNST": ["KUNSTSTOFFTECHNIK", "KUNSTSTOFF"],
    "GEBR": ["GEBRUDERS", "GEBRODERS", "GEBRUEDERS", "GEBROEDERS", "GEBRUEDER", "GEBRUDER", "GEB", "GEBROEDER", "GEBRODER"],
    "COOP": ["COOPERATIVA", "COOPERATIEVE", "CO-OPERATIVE", "COOPERATIVES", "COOPERATIVE", "CO-OPERATIVES"],
    "ZH": ["ZAIDAN HOJIN", "ZAIDAN HOUJIN"],
    "CIE IND": ["COMPAGNIE INDUSTRIALE", "COMPAGNIE INDUSTRIELLE", "COMPAGNIE INDUSTRIELLES"],
    "GRP": ["GROUPMENT", "GROUPEMENT"],
    "ENG": ["ENGINEERING"],
    "WERKZ MASCH KOMB": ["WERKZEUGMASCHINENKOMBINAT"],
    "DDR": ["DEMOKRATISCHEN REPUBLIK", "DEMOKRATISCHE"],
    "KONINK": ["KONINKLIJKE"],
    "SOC NOUV": ["SOCIETE NOUVELLE"],
    "CIE INT": ["COMPAGNIE INTERNATIONALE"],
    "ORG": ["ORGANISATION", "ORGANISATIE", "ORGANIZZAZIONE", "ORGANIZATIONS", "OYOSAKEYHTIO", "ORGANISATIONS", "ORGANIZATION"],
    "EV": ["EINGETRAGENER VEREIN"],
    "UNIV": ["UNIVERSITAIRE", "UNIVERSIDAD", "UNIVERSITAT", "UNIVERSITA", "UNIVERSITA DEGLI STUDI", "UNIVERSITETAM", "UNIVERSITETY", "UNIWERSYTET", "UNIVERSITAET", "UNIVERSIDADE", "UNIVERSITETE", "UNIVERSITEIT", "UNIVERSITETOV", "UNIVERSITAIR", "UNIVERSITETOM", "UNIVERSITETU", "UNIVERSITE", "UNIVERSITATEA", "UNIVERSITY", "UNIVERSITETAMI", "UNIVERSITET", "UNIVERSITETA"],
    "SA": ["SOCIEDAD ANONIMA", "SA DITE", "SOCIETE ANONYME DITE", "SOCIETE ANONYME"],
    "PROD CHIM": ["PRODUITS CHIMIQUES", "PRODUIT"],
    "INSTR": ["INSTRUMENTE", "INSTRUMENTS", "INSTRUMENTATION", "INSTRUMENT"],
    "INT": ["INTERNACIONAL", "INTERNATIONELLA", "INTERNATIONALEN", "INTERNAZIONALE", "INTERNATIONAL", "INTERNATIONAUX", "INTERNATIONALE"],
    "US": ["UNITED STATES OF AMERICA", "UNITED STATES"],
    "CIE PARIS": ["COMPAGNIE PARISIENNE", "COMPAGNIE PARISIEN", "COMPAGNIE PARISIENN"],
    "SPRL": ["SOCIETE PRIVEE A RESPONSABILITE LIMITEE"],
    "ASSOC": ["ASSOCIATE", "ASSOCIACAO", "ASSOCIATION", "ASSOCIATES", "ASSOCIATED"],
    "PRODN": ["PRODUKTIONS", "PRODUCTIONS", "PRODUZIONI", "PRODUCTION", "PRODUKTION"],
    "IND": ["INDUSTRIALIZAREA", "INDUSTRIYAM", "INDUSTRIYAMI", "INDUSTRII", "INDUSTRIELLE", "INDUSTRIEL", "INDUSTRIYAKH", "INDUSTRIALS", "INDUSTRIYA", "INDUSTRY", "INDUSTRIALE", "INDUSTRIELL", "INDUSTRIELS", "INDUSTRIE", "INDUSTRIALIZARE", "INDUSTRIEI", "INDUSTRIAS", "INDUSTRI", "INDUSTRIEELE", "INDUSTRIALI", "INDUSTRIES", "INDUSTRIAL", "INDUSTRIJ", "INDUSTRIALA", "INDUSTRIER", "INDUSTRIELLES", "INDUSTRIYU", "INDUSTRIA"],
    "PROD": ["PRODOTTI", "PRODUTOS", "PRODUCT", "PRODUKTE", "PRODUITS", "PRODUKTER", "PRODUKT", "PRODUCE", "PRODUCTOS", "PRODUCTORES", "PRODUKCJI", "PRODUCTIE", "PRODUCTS", "PRODUCTA", "PRODUSE", "PRODUCTAS", "PRODUCTO"],
    "SIDER": ["SIDERURGIC", "SIDERURGICA", "SIDERURGIE", "SIDERURGICAS", "SIDERURGIQUE"],
    "WTZ": ["WISSENSCHAFTLICHES TECHNISCHES ZENTRUM"],
    "INC": ["INCORPORATED", "INCORPORATION"],
    "REAL": ["REALISATIONS", "REALISATION"],
    "FR": ["FRANCAIS", "FRANCAISE"],
    "ACAD": ["ACADEMY"],
    "ESTAB": ["ESTABLISSEMENTS", "ESTABLISHMENT", "ESTABLISSEMENT", "ESTABLISHMENTS"],
    "US ADMIN": ["UNITED STATES OF AMERICA ADMINISTRATOR OF"],
    "SOC PARIS": ["SOCIETE PARISIENNE", "SOCIETE PARISIENN", "SOCIETE PARISIEN"],
    "FOUND": ["FOUNDATIONS", "FOUNDATION"],
    "ITAL": ["ITALIANE", "ITALI", "ITALIANO", "ITALIANI", "ITALIANA", "ITALIEN", "ITALIENNE", "ITALY", "ITALIA", "ITALIAN", "ITALO"],
    "RECH": ["RECHERCHES"],
    "IST": ["ISTITUTO"],
    "UTIL": ["UTILAJE", "UTILISATION", "UTILISATIONS", "UTILAJ"],
    "FA": ["FIRMA"],
    "PRZEYM": ["PRZEMYSLU"],
    "CHIM": ["CHIMIYU", "CHIMIKO", "CHIMICO", "CHIMIESKOJ", "CHIMIYAM", "CHIMII", "CHIMICA", "CHIMIYAKH", "CHIMIEI", "CHIMIC", "CHIMICI", "CHIMIYAMI", "CHIMIQUES", "CHIMIE", "CHIMIYA", "CHIMICE", "CHIMIQUE"],
    "UK SEC FOR": ["SECRETARY OF STATE FOR"],
    "KGAA": ["KOMMANDIT GESELLSCHAFT AUF AKTIEN", "KOMMANDITGESELLSCHAFT AUF AKTIEN"],
    "LAVORAZ": ["LAVORAZIONE", "LAVORAZA", "LAVORAZIO", "LAVORAZI", "LAVORAZIONI"],
    "MASCH": ["MASCHIN", "MASCHINENVERTRIEB", "MASCHINEN"],
    "INSTMSTO": ["INSINO", "INSINOEOERITOMISTO"],
    "APPL": ["APPLICAZIONI", "APPLICATIONS", "APPLICATION", "APPLICAZIONE"],
    "SEC": ["SECRETARY"],
    "NORDDEUT": ["NORDDEUTSCHE", "NORDDEUTSCH", "NORDDEUTSCHER", "NORDDEUTSCHES"],
    "EXPL": ["EXPLOITATION", "EXPLOITATIE", "EXPLOATERINGS", "EXPLOATERING", "EXPLOITATIONS"],
    "NP": ["NARODNY PODNIK", "NARODNIJ PODNIK", "NARODNI PODNIK"],
    "TECH": ["TECHNIQUES", "TECHNISCHE", "TECHNIKAI", "TECHNICZNY", "TECHNICO", "TECHNIK", "TECHNISCH", "TECHNIQUE", "TECHNIKI", "TECHNICAL", "TECHNISCHES"],
    "NV": ["NAAMLOZE VENNOOTSCHAP", "NAAMLOOSE VENOOTSCHAP"],
    "CIE NAT": ["COMPAGNIE NATIONALE"],
    "VER": ["VERENIGING", "VEREINIGTE", "VEREINIGTES", "VEREENIGDE", "VEREINIGUNG", "VEREIN"],
    "CC": ["CLOSE CORPORATION"],
    "RECH & DEV": ["RECHERCHES ET DEVELOPMENTS", "RECHERCHE", "RECHERCHES ET DEVELOPPEMENTS"],
    "SRL": ["SOCIEDAD DE RESPONSABILIDAD LIMITADA"],
    "MASCHBAU": ["MASCHINENBAUANSTALT", "MASCHINENBAU"],
    "COSTR": ["COSTRUZIONI"],
    "CORP": ["CORPORATE", "CORPORATION"],
    "PTE LTD": ["PRIVATE LIMITED"],
    "LTD": ["LIMITED"],
    "COMB": ["COMBINATUL"],
    "EURO": ["EUROPEA", "EUROPAEISCHES", "EUROPE", "EUROPEENNE", "EUROPAISCHES", "EUROPEAN", "EUROPAISCHEN", "EUROPAEISCHEN", "EUROPEEN", "EUROPAISCHE", "EUROPAEISCHE"],
    "OESTERR": ["OESTERREICHISCHES", "OESTERREICHISCHE", "OESTERREICHISCH", "OESTERREICH", "OSTERREICH"],
    "KG": ["KOMMANDITGESELLSCHAFT", "KOMMANDIT GESELLSCHAFT"],
    "SARL": ["SOCIETE A RESPONSIBILITE LIMITEE", "SOCIETE A RESPONSABILITE LIMITEE"],
    "KK": ["KABUSHIKI GAISHA", "KABUSHIKI KAISHA", "KABUSHIKI KAISYA", "KABUSHIKIKAISYA", "KABUSHIKIKAISHA"],
    "PVBA": ["PERSONENVENNOOTSCHAP MET BEPERKTE AANSPRAKELIJKHEID"],
    "SP": ["SDRUZENI PODNIK", "SDRUZENI PODNIKU"],
    "BET-GES": ["BETEILIGUNGSGESELLSCHAFT"],
    "SOC NAT": ["SOCIETE NATIONALE"],
    "HANDL": ["HANDELSMAATSCHAPPIJ", "HANDELSMIJ"],
    "KP": ["KONCERNOVY PODNIK"],
    "PLC": ["PUBLIC LIMITED COMPANY"],
    "APAR": ["APARATE", "APARARII", "APARATELOR"],
    "ETAB": ["ETABLISSEMENTS", "ETABS", "ETABLISSEMENT", "ETS"],
    "SOC CIV": ["SOCIEDAD CIVIL", "SOCIETE CIVILE"],
    "DEUT": ["DEUTSCH", "DEUTSCHLAND", "DEUTSCHES", "DEUTSCHER", "DEUTSCHE", "DEUTSCHEN"],
    "MASCHFAB": ["MASCHINENFABRIK", "MASCHINENFAB", "MASCHINENFABRIKEN", "MASCHINENFABRIEK"],
    "CIA": ["COMPANHIA", "COMPAGNIA"],
    "SOC ETUD": ["SOCIETE ETUDE", "SOCIETE ETUDES"],
    "CIE": ["COMPAGNIE"],
    "FARM": ["FARMACEVTSKIH", "FARMACEUTICHE", "FARMACEUTICA", "FARMACEUTICI", "FARMACEUTICO", "FARMACIE", "FARMACEUTISK", "FARMACEUTICOS", "FARMACEUTICE"],
    "YG": ["YUUGEN KAISYA", "YUGEN GAISHA", "YUUGEN KAISHA", "YUUGEN GAISHA", "YUGEN KAISHA"],
    "WESTDEUT": ["WESTDEUTSCHER", "WESTDEUTSCHE", "WESTDEUTSCH", "WESTDEUTSCHES"],
    "INST": ["INSTITUUT", "INSTITUTT", "INSTITUTAMKH", "INSTITUTU", "INSTYTUT", "INSTITUTAM", "INSTITUTO", "INSTITZHT", "INSTITUTA", "INSTITUTET", "INSTITUTES", "INST INSTITUTOM", "INSTITUTOV", "INSTITUTY", "INSTITUTUL", "INSTITUTAMI", "INSTITUTE"],
    "AGRI": ["AGRICULTURAL", "AGRICOLE", "AGRICOLAS", "AGRICOLTURE", "AGRICOLES", "AGRICULTURE", "AGRICOLI", "AGRICOLA", "AGRICULTURA"],
    "FOND": ["FONDAZIONE", "FONDATION"],
    "SOC GEN": ["SOCIETE GENERALE"],
    "DIV": ["DIVISIONE", "DIVISION"],
    "SPITAL": ["SPITALUL"],
    "SOC COMML": ["SOCIETE COMMERCIALES", "SOCIETE COMMERCIALE"],
    "SOC": ["SOCIETA", "SOCIETY", "SOCIEDADE", "SOCIEDAD", "SOCIETE"],
    "MBH": ["MIT BESCHRANKTER HAFTUNG"],
    "PRZEDSIEB": ["PRZEDSIEBIOSTWO"],
    "SOC IND": ["SOCIETE INDUSTRIELLE", "SOCIETE INDUSTRIELLES"],
    "LP": ["LIMITED PARTNERSHIP"],
    "FAB": ["FABBRICA", "FABRIZIO", "FABRIKER", "FABBRICHE", "FABRIK", "FABRICA", "FABRIQUE", "FABRICATIONS", "FABRIEKEN", "FABRICATION", "FABRIEK", "FABRYKA", "FABBRICAZIONI", "FABRIQUES"],
    "COMML": ["COMMERCIAL", "COMMERCIALE"],
    "AB": ["AKTIEBOLAGET", "AKTIEBOLAG"],
    "UK": ["UNITED KINGDOM"],
    "VERW": ["VERWALTUNGS", "VERWALTUNGEN", "VERWERTUNGS"],
    "AKAD": ["AKADEMIYU", "AKADEMIYAM", "AKADEMIYAMI", "AKADEMIYA", "AKADEMIA", "AKADEMI", "AKADEMIJA", "AKADEMIYAKH", "AKADEMII", "AKADEMIE", "AKADEMIEI"],
    "ANTR": ["ANTREPRIZA"],
    "SOC AUX": ["SOCIETE AUXILIAIRE"],
    "AS": ["AKTIESELSKABET", "A/S", "AKTIESELSKAB"],
    "BROS": ["BROTHERS"],
    "VU": ["VYZKUMNY USTAV", "VYZK USTAV", "VYZKUMNYUSTAV"],
    "INTR": ["INTREPRINDEREA"],
    "CIE GEN": ["COMPAGNIE GENERALE"],
    "GEW": ["GEWERKSCHAFT"],
    "MTA": ["MAGYAR TUDOMANYOS AKADEMIA"],
    "SOC ESPAN": ["SOCIEDAD ESPANOLA"],
    "WERKZ MASCHFAB": ["WERKZEUGMASCHINENFABRIK"],
    "SOC MEC": ["SOCIETE MECANIQUES", "SOCIETE MECANIQUE"],
    "ING": ["INGENIEURBUERO", "INGENIEUR", "INGENIORSFIRMA", "INGENIERIA", "INGENIORSFIRMAN", "INGENIEURBURO", "INGENIEURTECHNISCHES", "INGENIEURBUREAU", "INGENIEURS", "INGENIEURSBUREAU", "INGENIOERFIRMAET", "INGENJORSFIRMA", "INGENIEURGESELLSCHAFT", "INGINERIE", "INGENIEURTECHNISCHE", "INGENIER"],
    "CERC": ["CERCETARI", "CERCETARE"],
    "VEB KOMB": ["VEB KOMBINAT"],
    "TELECOM": ["TELECOMMUNICAZIONI", "TELECOMMUNICATION", "TELECOMUNICAZIONI", "TELECOMMUNICATIONS", "TELECOMMUNICACION"],
    "PROI": ["PROIECTARE", "PROIECTARI"],
    "PHARM": ["PHARMACEUTIQUES", "PHARMAZIE", "PHARMACEUTICA", "PHARMAZEUTISCHE", "PHARMAZEUTISCHEN", "PHARMACEUTICALS", "PHARMAZEUTISCH", "PHARMACEUTIQUE", "PHARMACEUTICAL", "PHARMAZEUTIKA"],
    "ZENT LAB": ["ZENTRALLABORATORIUM"],
    "EQUIP": ["EQUIPMENT", "EQUIPEMENT", "EQUIPEMENTS", "EQUIPMENTS"],
    "TRUST": ["TRUSTUL"],
    "AKTIENGESELLSCHAFT": ["AGACTIEN GESELLSCHAFT", "ACTIENGESELLSCHAFT", "AKTIEN GESELLSCHAFT"],
}

# Windows-1252 characters in plain ASCII.
ASCII = {
    "€": "EUR",
    "\x81": " ",
    "‚": ",",
    "ƒ": "f",
    "„": ",,",
    "…": "...",
    "†": "+",
    "‡": "++",
    "ˆ": "^",
    "‰": "%",
    "Š": "S",
    "‹": "<",
    "Œ": "OE",
    "\x8d": "?",
    "Ž": "Z",
    "\x8f": "?",
    "\x90": "?",
    "‘": "'",
    "’": "'",
    "“": '"',
    "”": '"',
    "•": "*",
    "–": "-",
    "—": "--",
    "˜": "~",
    "™": "(TM)",
    "š": "s",
    "›": ">",
    "œ": "oe",
    "\x9d": "?",
    "ž": "z",
    "Ÿ": "Y",
    "\xa0": " ",
    "¡": "!",
    "¢": "c",
    "£": "GBP",
    "¤": "$",
    "¥": "YEN",
    "¦": "|",
    "§": "S",
    "¨": "..",
    "©": "",
    "ª": "(th)",
    "«": "<<",
    "¬": "!",
    "\xad": " ",
    "®": "(R)",
    "¯": "-",
    "°": "o",
    "±": "+-",
    "²": "2",
    "³": "3",
    "´": "'",
    "µ": "u",
    "¶": "P",
    "·": "*",
    "¸": ",",
    "¹": "1",
    "º": "(th)",
    "»": ">>",
    "¼": "1/4",
    "½": "1/2",
    "¾": "3/4",
    "¿": "?",
    "Æ": "AE",
    "Ð": "D",
    "×": "*",
    "Ø": "O",
    "Þ": "b",
    "ß": "B",
    "æ": "ae",
    "ð": "o",
    "ø": "o",
    "þ": "b",
    "÷": "/",
}

# Characters that have no HTML name in the published map: they become their ASCII form there.
NO_HTML_NAME = ["\x81", "‰", "\x8d", "Ž", "\x8f", "\x90", "\x9d", "ž"]

# HTML names of the published map that differ from those of HTML 4.
HTML_NAMES = {
    "ˆ": "caret",
    "‹": "lt;",
    "›": "gt",
    "±": "plusmm",
    "Æ": "Aelig",
    "Ð": "Eth",
    "Þ": "Thorn",
}
