"""Values that synthetic bills draw from."""

CITIES = ("Hyderabad", "Pune", "Chennai", "Kochi", "Jaipur", "Indore", "Nagpur", "Surat")
MALE = ("Arun", "Vikram", "Suresh", "Imran", "Joseph", "Karthik", "Manoj", "Rahul")
FEMALE = ("Asha", "Divya", "Fatima", "Kavitha", "Lakshmi", "Meera", "Priya", "Sunita")
FAMILY = ("Rao", "Sharma", "Khan", "Nair", "Patel", "Reddy", "Iyer", "Das")
INSURERS = ("Northern Mutual", "Coastal Health", "Unity Assurance", "Deccan General")
WARDS = {"General": 0.35, "Semi-Private": 0.25, "Private": 0.25, "ICU": 0.10, "Deluxe": 0.05}
#: description, category, lowest and highest rate; the room comes first.
ITEMS = (
    ("Room Rent", "room_rent", 1500, 9000), ("Nursing Charges", "nursing", 300, 1500), ("Injection Ceftriaxone", "pharmacy", 60, 900), ("Surgical Gloves", "consumables", 20, 200),
    ("Complete Blood Count", "diagnostics", 200, 900), ("X-Ray Chest PA", "radiology", 300, 1200), ("Operation Theatre Charges", "surgery", 5000, 60000), ("Consultant Visit", "professional_fees", 500, 2500),
    ("Oxygen Charges", "equipment", 200, 2000), ("Registration Fee", "administrative", 100, 500), ("Attendant Charges", "non_medical", 100, 800), ("Ambulance", "other", 500, 4000),
)
