"""The dimension rows as the checking SQL states them, apart from the tables the queries read (sources/dims)."""

# Fixed values.
CAMERAS_SQL = """
(0, 'Apple', 'iPhone 15 Pro', 'iOS 17.4.1', 'phone', [1.78, 2.2], [25, 32, 40, 50, 64, 80, 100, 125, 160, 200, 250, 400, 640, 800, 1000, 1600, 2500, 3200], [{'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}, {'num': 1, 'den': 15}], [26, 48, 120]),
(1, 'Apple', 'iPhone 14 Pro Max', 'iOS 16.7.8', 'phone', [1.78, 2.2], [25, 32, 50, 64, 100, 125, 200, 400, 640, 1600, 2500], [{'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}], [24, 77]),
(2, 'Apple', 'iPhone 13 Pro', 'iOS 15.8.3', 'phone', [1.5, 1.8, 2.8], [25, 50, 100, 200, 400, 800, 1600, 2000], [{'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}], [26, 77]),
(3, 'Apple', 'iPhone 12', 'iOS 14.8.1', 'phone', [1.6, 2.4], [25, 50, 100, 200, 400, 800, 1600], [{'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}], [26, 52]),
(4, 'Samsung', 'SM-S928B', 'S928BXXU1AWIM', 'phone', [1.7, 2.2, 3.4], [50, 100, 200, 400, 800, 1600, 3200], [{'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}], [13, 23, 69, 230]),
(5, 'Samsung', 'SM-S916B', 'S916BXXU7EXA1', 'phone', [1.8, 2.4], [50, 100, 200, 400, 800, 1600, 3200], [{'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}], [13, 23, 69]),
(6, 'Samsung', 'SM-A546B', 'A546BXXS4EXD2', 'phone', [1.8, 2.4], [50, 100, 200, 400, 800, 1600], [{'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}], [25, 63]),
(7, 'Google', 'Pixel 8 Pro', 'android.14', 'phone', [1.68, 2.2, 2.8], [50, 100, 200, 400, 800, 1600, 3200], [{'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}], [10, 25, 113]),
(8, 'Google', 'Pixel 7a', 'android.13', 'phone', [1.89, 2.2], [50, 100, 200, 400, 800, 1600, 3200], [{'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}], [25, 116]),
(9, 'Canon', 'Canon EOS R5', 'Firmware Version 1.8.2', 'dslr', [1.2, 1.4, 1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0, 16.0], [100, 125, 160, 200, 250, 320, 400, 640, 800, 1600, 3200, 6400, 12800, 25600, 51200], [{'num': 1, 'den': 8000}, {'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}, {'num': 1, 'den': 15}, {'num': 1, 'den': 8}, {'num': 1, 'den': 4}, {'num': 1, 'den': 2}, {'num': 1, 'den': 1}, {'num': 2, 'den': 1}, {'num': 4, 'den': 1}], [24, 35, 50, 85, 100, 135, 200]),
(10, 'Canon', 'Canon EOS 5D Mark IV', 'Firmware Version 1.3.3', 'dslr', [1.4, 1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0, 16.0], [100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600], [{'num': 1, 'den': 8000}, {'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}, {'num': 1, 'den': 15}, {'num': 1, 'den': 8}, {'num': 1, 'den': 4}], [24, 35, 50, 85, 135, 200]),
(11, 'Canon', 'Canon EOS 90D', 'Firmware Version 1.1.1', 'dslr', [1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0], [100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600], [{'num': 1, 'den': 8000}, {'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}], [18, 24, 35, 50, 85, 100]),
(12, 'Nikon', 'NIKON Z9', 'Ver.4.00', 'dslr', [1.4, 1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0], [64, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 51200, 102400], [{'num': 1, 'den': 32000}, {'num': 1, 'den': 8000}, {'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}, {'num': 1, 'den': 15}, {'num': 1, 'den': 8}], [24, 35, 50, 85, 105, 200, 400]),
(13, 'Nikon', 'NIKON D850', 'Ver.1.10', 'dslr', [1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0, 16.0], [64, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600], [{'num': 1, 'den': 8000}, {'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}, {'num': 1, 'den': 15}], [24, 35, 50, 85, 135, 200]),
(14, 'Nikon', 'NIKON Z6II', 'Ver.1.40', 'dslr', [1.4, 1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0], [100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 51200], [{'num': 1, 'den': 8000}, {'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}, {'num': 1, 'den': 15}], [24, 35, 50, 85, 105]),
(15, 'Sony', 'ILCE-7M4', 'Ver.2.01', 'dslr', [1.4, 1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0], [50, 100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 51200, 102400, 204800], [{'num': 1, 'den': 8000}, {'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}, {'num': 1, 'den': 15}, {'num': 1, 'den': 8}], [24, 35, 50, 85, 135, 200]),
(16, 'Sony', 'ILCE-7RM5', 'Ver.1.00', 'dslr', [1.4, 1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0], [100, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 51200], [{'num': 1, 'den': 8000}, {'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}], [24, 35, 50, 85, 135]),
(17, 'FUJIFILM', 'X-T5', 'Firmware Ver2.00', 'dslr', [1.4, 1.8, 2.0, 2.8, 4.0, 5.6, 8.0, 11.0], [125, 160, 200, 400, 800, 1600, 3200, 6400, 12800, 25600, 51200], [{'num': 1, 'den': 8000}, {'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}, {'num': 1, 'den': 15}], [18, 23, 35, 56, 90]),
(18, 'FUJIFILM', 'X100VI', 'Firmware Ver2.10', 'dslr', [2.0, 2.8, 4.0, 5.6, 8.0, 11.0], [125, 200, 400, 800, 1600, 3200, 6400, 12800, 25600], [{'num': 1, 'den': 4000}, {'num': 1, 'den': 2000}, {'num': 1, 'den': 1000}, {'num': 1, 'den': 500}, {'num': 1, 'den': 250}, {'num': 1, 'den': 125}, {'num': 1, 'den': 60}, {'num': 1, 'den': 30}], [23])
"""

# Fixed values.
LENSES_SQL = """
(0, 'Canon', 'Canon RF 24-70mm F2.8 L IS USM', 24, 70),
(1, 'Canon', 'Canon RF 50mm F1.8 STM', 50, 50),
(2, 'Canon', 'Canon RF 85mm F1.2 L USM', 85, 85),
(3, 'Canon', 'Canon EF 70-200mm f/2.8L IS III USM', 70, 200),
(4, 'Canon', 'Canon RF 24-105mm F4 L IS USM', 24, 105),
(5, 'Canon', 'Canon RF 35mm F1.8 MACRO IS STM', 35, 35),
(6, 'Canon', 'Canon EF 135mm f/2L USM', 135, 135),
(7, 'Canon', 'Canon RF 100-400mm F5.6-8 IS USM', 100, 400),
(8, 'Nikon', 'NIKKOR Z 24-70mm f/2.8 S', 24, 70),
(9, 'Nikon', 'NIKKOR Z 50mm f/1.8 S', 50, 50),
(10, 'Nikon', 'NIKKOR Z 85mm f/1.8 S', 85, 85),
(11, 'Nikon', 'NIKKOR Z 70-200mm f/2.8 VR S', 70, 200),
(12, 'Nikon', 'NIKKOR Z 24-200mm f/4-6.3 VR', 24, 200),
(13, 'Nikon', 'AF-S NIKKOR 105mm f/1.4E ED', 105, 105),
(14, 'Nikon', 'NIKKOR Z 35mm f/1.8 S', 35, 35),
(15, 'Nikon', 'AF-S NIKKOR 200-500mm f/5.6E ED VR', 200, 500),
(16, 'Sony', 'FE 24-70mm F2.8 GM II', 24, 70),
(17, 'Sony', 'FE 50mm F1.8', 50, 50),
(18, 'Sony', 'FE 85mm F1.4 GM', 85, 85),
(19, 'Sony', 'FE 70-200mm F2.8 GM OSS II', 70, 200),
(20, 'Sony', 'FE 135mm F1.8 GM', 135, 135),
(21, 'Sony', 'FE 35mm F1.4 GM', 35, 35),
(22, 'Sony', 'FE 24-105mm F4 G OSS', 24, 105),
(23, 'FUJIFILM', 'XF23mmF2 R WR', 23, 23),
(24, 'FUJIFILM', 'XF35mmF1.4 R', 35, 35),
(25, 'FUJIFILM', 'XF56mmF1.2 R', 56, 56),
(26, 'FUJIFILM', 'XF18-55mmF2.8-4 R LM OIS', 18, 55),
(27, 'FUJIFILM', 'XF90mmF2 R LM WR', 90, 90),
(28, 'FUJIFILM', 'XF55-200mmF3.5-4.8 R LM OIS', 55, 200)
"""

# Fixed values.
LOCATIONS_SQL = """
(0, 'New York, NY', 40.7128, -74.0060),
(1, 'Brooklyn, NY', 40.6782, -73.9442),
(2, 'Boston, MA', 42.3601, -71.0589),
(3, 'Philadelphia, PA', 39.9526, -75.1652),
(4, 'Washington, DC', 38.9072, -77.0369),
(5, 'Baltimore, MD', 39.2904, -76.6122),
(6, 'Pittsburgh, PA', 40.4406, -79.9959),
(7, 'Hartford, CT', 41.7637, -72.6851),
(8, 'Providence, RI', 41.8240, -71.4128),
(9, 'Newark, NJ', 40.7357, -74.1724),
(10, 'Miami, FL', 25.7617, -80.1918),
(11, 'Orlando, FL', 28.5383, -81.3792),
(12, 'Tampa, FL', 27.9506, -82.4572),
(13, 'Jacksonville, FL', 30.3322, -81.6557),
(14, 'Atlanta, GA', 33.7490, -84.3880),
(15, 'Charlotte, NC', 35.2271, -80.8431),
(16, 'Raleigh, NC', 35.7796, -78.6382),
(17, 'Nashville, TN', 36.1627, -86.7816),
(18, 'Memphis, TN', 35.1495, -90.0490),
(19, 'New Orleans, LA', 29.9511, -90.0715),
(20, 'Birmingham, AL', 33.5186, -86.8104),
(21, 'Richmond, VA', 37.5407, -77.4360),
(22, 'Chicago, IL', 41.8781, -87.6298),
(23, 'Detroit, MI', 42.3314, -83.0458),
(24, 'Columbus, OH', 39.9612, -82.9988),
(25, 'Cleveland, OH', 41.4993, -81.6944),
(26, 'Indianapolis, IN', 39.7684, -86.1581),
(27, 'Milwaukee, WI', 43.0389, -87.9065),
(28, 'Minneapolis, MN', 44.9778, -93.2650),
(29, 'St. Louis, MO', 38.6270, -90.1994),
(30, 'Kansas City, MO', 39.0997, -94.5786),
(31, 'Omaha, NE', 41.2565, -95.9345),
(32, 'Des Moines, IA', 41.5868, -93.6250),
(33, 'Los Angeles, CA', 34.0522, -118.2437),
(34, 'San Diego, CA', 32.7157, -117.1611),
(35, 'San Jose, CA', 37.3382, -121.8863),
(36, 'San Francisco, CA', 37.7749, -122.4194),
(37, 'Sacramento, CA', 38.5816, -121.4944),
(38, 'Fresno, CA', 36.7378, -119.7871),
(39, 'Las Vegas, NV', 36.1699, -115.1398),
(40, 'Phoenix, AZ', 33.4484, -112.0740),
(41, 'Tucson, AZ', 32.2226, -110.9747),
(42, 'Albuquerque, NM', 35.0844, -106.6504),
(43, 'El Paso, TX', 31.7619, -106.4850),
(44, 'Denver, CO', 39.7392, -104.9903),
(45, 'Colorado Springs, CO', 38.8339, -104.8214),
(46, 'Salt Lake City, UT', 40.7608, -111.8910),
(47, 'Houston, TX', 29.7604, -95.3698),
(48, 'Dallas, TX', 32.7767, -96.7970),
(49, 'Austin, TX', 30.2672, -97.7431),
(50, 'San Antonio, TX', 29.4241, -98.4936),
(51, 'Fort Worth, TX', 32.7555, -97.3308),
(52, 'Seattle, WA', 47.6062, -122.3321),
(53, 'Portland, OR', 45.5051, -122.6750),
(54, 'Spokane, WA', 47.6588, -117.4260),
(55, 'Boise, ID', 43.6150, -116.2023),
(56, 'Anchorage, AK', 61.2181, -149.9003),
(57, 'Honolulu, HI', 21.3069, -157.8583)
"""

# Fixed values.
FIELDS_SQL = """
(0, 'device', 'Device', 0, 'Make', 'Camera Make'),
(0, 'device', 'Device', 1, 'Model', 'Camera Model'),
(0, 'device', 'Device', 2, 'Software', 'Software'),
(0, 'device', 'Device', 3, 'LensMake', 'Lens Make'),
(0, 'device', 'Device', 4, 'LensModel', 'Lens Model'),
(1, 'capture', 'Capture Settings', 0, 'DateTimeOriginal', 'Date Taken'),
(1, 'capture', 'Capture Settings', 1, 'DateTime', 'Date Modified'),
(1, 'capture', 'Capture Settings', 2, 'SubSecTimeOriginal', 'Sub-Second'),
(1, 'capture', 'Capture Settings', 3, 'ExposureTime', 'Shutter Speed'),
(1, 'capture', 'Capture Settings', 4, 'FNumber', 'Aperture'),
(1, 'capture', 'Capture Settings', 5, 'ISO', 'ISO'),
(1, 'capture', 'Capture Settings', 6, 'FocalLength', 'Focal Length'),
(1, 'capture', 'Capture Settings', 7, 'FocalLengthIn35mmFormat', '35mm Equiv.'),
(1, 'capture', 'Capture Settings', 8, 'Flash', 'Flash'),
(1, 'capture', 'Capture Settings', 9, 'MeteringMode', 'Metering'),
(1, 'capture', 'Capture Settings', 10, 'ExposureProgram', 'Program'),
(1, 'capture', 'Capture Settings', 11, 'ExposureMode', 'Exposure Mode'),
(1, 'capture', 'Capture Settings', 12, 'WhiteBalance', 'White Balance'),
(1, 'capture', 'Capture Settings', 13, 'SceneCaptureType', 'Scene Capture'),
(1, 'capture', 'Capture Settings', 14, 'SensingMethod', 'Sensor'),
(2, 'gps', 'Location (GPS)', 0, 'GPSLatitude', 'Latitude'),
(2, 'gps', 'Location (GPS)', 1, 'GPSLongitude', 'Longitude'),
(2, 'gps', 'Location (GPS)', 2, 'GPSAltitude', 'Altitude'),
(3, 'image', 'Image', 0, 'PixelXDimension', 'Pixel Width'),
(3, 'image', 'Image', 1, 'PixelYDimension', 'Pixel Height'),
(3, 'image', 'Image', 2, 'ImageWidth', 'Width'),
(3, 'image', 'Image', 3, 'ImageHeight', 'Height'),
(3, 'image', 'Image', 4, 'Orientation', 'Orientation'),
(3, 'image', 'Image', 5, 'ColorSpace', 'Color Space'),
(3, 'image', 'Image', 6, 'XResolution', 'X Resolution'),
(3, 'image', 'Image', 7, 'YResolution', 'Y Resolution')
"""

# Fixed values.
CODES_SQL = """
('Flash', 0, 'No flash'),
('Flash', 1, 'Flash fired'),
('Flash', 16, 'Flash off'),
('Flash', 24, 'Flash off'),
('Flash', 25, 'Flash fired'),
('Flash', 31, 'Flash fired + red-eye'),
('MeteringMode', 1, 'Average'),
('MeteringMode', 2, 'Center-weighted'),
('MeteringMode', 3, 'Spot'),
('MeteringMode', 4, 'Multi-spot'),
('MeteringMode', 5, 'Multi-segment'),
('MeteringMode', 6, 'Partial'),
('ExposureProgram', 0, 'Not defined'),
('ExposureProgram', 1, 'Manual'),
('ExposureProgram', 2, 'Auto'),
('ExposureProgram', 3, 'Aperture priority'),
('ExposureProgram', 4, 'Shutter priority'),
('ExposureProgram', 5, 'Creative'),
('ExposureProgram', 6, 'Action'),
('ExposureProgram', 7, 'Portrait'),
('ExposureProgram', 8, 'Landscape'),
('Orientation', 1, 'Normal (0 deg)'),
('Orientation', 3, 'Rotated 180 deg'),
('Orientation', 6, 'Rotated 90 deg CW'),
('Orientation', 8, 'Rotated 90 deg CCW'),
('WhiteBalance', 0, 'Auto'),
('WhiteBalance', 1, 'Manual'),
('ColorSpace', 1, 'sRGB'),
('ColorSpace', 65535, 'Uncalibrated'),
('ExposureMode', 0, 'Auto'),
('ExposureMode', 1, 'Manual'),
('ExposureMode', 2, 'Auto bracket'),
('SceneCaptureType', 0, 'Standard'),
('SceneCaptureType', 1, 'Landscape'),
('SceneCaptureType', 2, 'Portrait'),
('SceneCaptureType', 3, 'Night'),
('SensingMethod', 1, 'Not defined'),
('SensingMethod', 2, 'One-chip color area'),
('SensingMethod', 3, 'Two-chip color area'),
('SensingMethod', 4, 'Three-chip color area'),
('SensingMethod', 5, 'Color sequential area'),
('SensingMethod', 7, 'Trilinear'),
('SensingMethod', 8, 'Color sequential linear')
"""

ROWS_SQL = {"cameras": CAMERAS_SQL, "lenses": LENSES_SQL, "locations": LOCATIONS_SQL, "exif_fields": FIELDS_SQL, "exif_codes": CODES_SQL}
